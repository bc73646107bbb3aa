"""URL filter: block and allow rules in a sorted array of 64-bit digests.

The digest of a rule is xxhash64 of `host path` (host, then the path, which begins with a slash). The array is written
to the shared folder as one file of four sections (sorted digests, string ends, verdicts, strings), which tasks
memory-map. A url asks for each suffix of its host with each prefix of its path that is as long as some rule's path;
all asks of a batch are found with one binary search over the whole array, and a digest counts only if the stored
string is the asked one. The longest rule that fits decides; equally long ones fit one url only if they are equal, and
then "block" wins.

Rules come as a DataFrame (rule, verdict): `host/`, `host/path`. Several rules of one text are one rule; NULL rules are
left out. The array is built by one task from the distinct rules, so its memory is theirs (10 million rules take about
600 MB); the urls are not shuffled. A NULL url, or one without `://`, has an empty host and path and fits no rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from argweave.llm.common import map_file, put_file, run_folder

VERDICTS = ("allow", "block")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a url; both empty without `://`."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://((?s:.*))$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def _pack(rules: list[tuple[str, str]]) -> bytes:
    """The file of the rules: their number, sorted digests, string ends, verdicts, strings."""
    rows = sorted((xxhash.xxh64_intdigest(text.encode()), text.encode(), VERDICTS.index(verdict)) for text, verdict in rules)
    digests = np.array([x for x, _, _ in rows], "<u8")
    ends = np.cumsum([0, *(len(x) for _, x, _ in rows)]).astype("<u8")
    verdicts = np.array([x for _, _, x in rows], np.uint8)
    return b"".join((np.uint64(len(rows)).tobytes(), digests.tobytes(), ends.tobytes(), verdicts.tobytes(), b"".join(x for _, x, _ in rows)))


class Digests:
    """The mapped array; nothing is read before it is asked for."""

    def __init__(self, data: np.ndarray):
        n = int(data[:8].view("<u8")[0])
        self.digests = data[8 : 8 + 8 * n].view("<u8")
        self.ends = data[8 + 8 * n : 16 + 16 * n].view("<u8")
        self.verdicts = data[16 + 16 * n : 16 + 17 * n]
        self.strings = data[16 + 17 * n :]

    def find(self, asked: list[bytes]) -> list[int]:
        """For each string its place, or -1."""
        keys = np.fromiter(map(xxhash.xxh64_intdigest, asked), np.uint64, len(asked))
        places = np.searchsorted(self.digests, keys)
        found = [-1] * len(asked)
        hits = np.flatnonzero(places < len(self.digests))
        for k in hits[self.digests[places[hits]] == keys[hits]]:
            at = int(places[k])
            while at < len(self.digests) and self.digests[at] == keys[k]:  # strings that share a digest stand together
                if self.strings[int(self.ends[at]) : int(self.ends[at + 1])].tobytes() == asked[k]:
                    found[k] = at
                    break
                at += 1
        return found


def build(rules: DataFrame) -> tuple[str, list[int]]:
    """Write the array; its place, and the lengths of the rules' paths."""
    folder = run_folder(rules.sparkSession)
    split = F.expr("locate('/', rule)")
    rules = rules.where("rule is not null and locate('/', rule) > 0")
    unknown = rules.where(~F.coalesce(F.col("verdict").isin(*VERDICTS), F.lit(False))).select("rule", "verdict").head()
    if unknown is not None:
        raise ValueError(f"The verdict of rule {unknown.rule!r} is {unknown.verdict!r}; it must be one of {', '.join(VERDICTS)}.")
    rules = (
        rules
        .groupBy("rule")
        .agg(F.max("verdict").alias("verdict"))
        .withColumn("length", F.length("rule") - split + 1)
    )
    uri = f"{folder}/digests"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["rule"], r["verdict"]) for b in batches for r in b.to_pylist()]
        put_file(uri, _pack(rows))
        yield pa.RecordBatch.from_pydict({"n": pa.array([len(rows)], pa.int64())})

    lengths = [row.length for row in rules.select("length").distinct().collect()]  # distinct lengths, not rules
    rules.select("rule", "verdict").coalesce(1).mapInArrow(write, "n long").collect()
    return uri, sorted(lengths)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """`pages` with host, path, rule (NULL if none fits) and verdict (allow if none fits). Columns of `pages` that
    have one of these names are replaced."""
    uri, lengths = build(rules)
    host, path = host_and_path(F.col(url))
    ready = pages.withColumns({"host": host, "path": path}).withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("allow")})
    schema = ready.schema

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Digests(map_file(uri))
        for batch in batches:
            asked: dict[bytes, int] = {}
            rows = []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                parts = host.split(".")
                suffixes = [".".join(parts[k:]) for k in range(len(parts))]
                heads = [path[:n] for n in lengths if n <= len(path)]
                rows.append([asked.setdefault((s + h).encode(), len(asked)) for s in suffixes for h in heads])
            strings = list(asked)
            found = index.find(strings)
            rule, verdict = [], []
            for asks in rows:
                best = max((k for k in asks if found[k] >= 0), key=lambda k: len(strings[k].decode()), default=-1)
                rule.append(strings[best].decode() if best >= 0 else None)
                verdict.append(VERDICTS[index.verdicts[found[best]]] if best >= 0 else "allow")
            new = {"rule": pa.array(rule, pa.string()), "verdict": pa.array(verdict, pa.string())}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(n)) for n in batch.schema.names], names=batch.schema.names)

    return ready.mapInArrow(probe, schema)
