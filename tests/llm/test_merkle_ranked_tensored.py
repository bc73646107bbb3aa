"""Merkle manifest, ranked search and tensored MinHash against plain loops, on odd rows and with small limits."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from argweave.llm import merkle, places, ranked, tensored
from argweave.llm.queries import QUERIES


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def climb(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root over `nodes`, and per leaf the siblings (left, right) of every level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, place in enumerate(at):
            run = place - place % 3
            paths[leaf].append(("".join(nodes[run:place]), "".join(nodes[place + 1 : run + 3])))
        nodes = [sha(*nodes[k : k + 3]) for k in range(0, len(nodes), 3)]
        at = [place // 3 for place in at]
    return nodes[0], paths


def manifest_of(rows: list[tuple]) -> list[tuple]:
    """(key, leaf, subroot, root, path) of rows (group, key, leaf) by a plain loop."""
    groups: dict = {}
    for group, key, leaf in rows:
        groups.setdefault(group, []).append((key is not None, key or 0, leaf, key))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: climb([r[2] for r in sorted(groups[g])]) for g in order}
    root, over = climb([trees[g][0] for g in order])
    out = []
    for g, above in zip(order, over, strict=True):
        for (_, _, leaf, key), path in zip(sorted(groups[g]), trees[g][1], strict=True):
            out.append((key, leaf, trees[g][0], root, tuple(path + above)))
    return out


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_manifest_is_that_of_a_plain_loop(spark, depth):
    rows = [("hot", k, sha(str(k))) for k in range(100)] + [(None, 5, sha("n")), ("é", 1, sha("x")), ("z", 1, sha("y")), ("z", 1, sha("y"))]
    rows += [("hot", None, sha("none")), ("hot", 3, sha("other"))] + [(f"s{k}", k, sha(f"s{k}")) for k in range(11)]
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string").repartition(5)
    got = merkle.manifest(df, "source", "doc_id", "leaf", depth=depth)
    found = [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s.left, s.right) for s in r.path)) for r in got.collect()]
    assert sorted(found, key=repr) == sorted(manifest_of(rows), key=repr)


def test_folding_a_path_leads_to_the_root_and_a_changed_leaf_does_not(spark):
    rows = [("a", k, sha(str(k))) for k in range(31)]
    got = merkle.manifest(spark.createDataFrame(rows, "source string, doc_id long, leaf string"), "source", "doc_id", "leaf", depth=2)
    right = got.select((merkle.folded(F.col("leaf"), F.col("path")) == F.col("root")).alias("x"), (merkle.folded(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("y"))
    assert {(r.x, r.y) for r in right.collect()} == {(True, False)}


def test_a_lone_leaf_is_the_root_and_has_an_empty_proof(spark):
    df = spark.createDataFrame([(None, None, sha("a"))], "source string, doc_id long, leaf string")
    row = merkle.manifest(df, "source", "doc_id", "leaf").select("*", merkle.proof_digest(F.col("path")).alias("proof")).head()
    assert (row.subroot, row.root, list(row.path), row.proof) == (sha("a"), sha("a"), [], sha(""))


def documents(spark, rows, path):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _metadata string, idx long, score long, file long")
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


ODD = [None, "", " \n\t", "one", "two words", "a b c d e", "same text of six words here", "same text of six words here", "İ Ünïcode ß words and more\x1cof it", "word " * 200_000, "\x0b\x0c"]


@pytest.fixture(scope="module")
def odd_folder(spark, tmp_path_factory):
    rows = [(k, t, None if k % 3 else "en", None if k % 4 == 1 else f"s{k % 2}", None if k == 2 else len(t or ""), "clash", k, k, k) for k, t in enumerate(ODD)]
    rows += [(None, "no id here at all", None, None, None, None, 0, 0, 0), (3, "one", "en", "s1", 3, "clash", 3, 3, 3), (6, "same text of six words here", "en", "s0", 27, None, 1, 1, 1)]
    folder = documents(spark, rows, tmp_path_factory.mktemp("odd"))
    items = [(1, "one two"), (2, None), (3, ""), (4, "WORD word same"), (1, "one two"), (None, "six ünïcode")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


@pytest.fixture(scope="module")
def empty_folder(spark, tmp_path_factory):
    folder = documents(spark, [], tmp_path_factory.mktemp("empty"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_ranked_search", "op13_minhash_dedup"])
def test_empty_tables_give_no_rows(spark, empty_folder, name):
    assert QUERIES[name](spark, empty_folder).collect() == []


def test_manifest_of_odd_documents(spark, odd_folder):
    folder, rows, _ = odd_folder

    def leaf(doc_id, text, lang, source, n):
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n, text)))

    leaves = [leaf(*r[:5]) for r in rows]
    want = manifest_of([(r[3], r[0], x) for r, x in zip(rows, leaves, strict=True)])
    got = QUERIES["op11_merkle_manifest"](spark, folder).collect()
    assert sorted(((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got), key=repr) == sorted(((*w[:4], sha(*(x for s in w[4] for x in s))) for w in want), key=repr)
    from zlib import crc32

    broken = {r[0] for r in rows if r[0] is not None and crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[1] or "")}
    assert {r.doc_id for r in got if not r.verified} == broken
    assert all(r.verified == (r.folded_root == r.root) for r in got)


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def best(docs: list[tuple], items: list[tuple], k: int) -> list[tuple]:
    terms = [TERM.findall((t or "").translate(LOWER)) for _, t in docs]
    n, total = sum(1 for t in terms if t), sum(map(len, terms))
    df: dict = {}
    for t in terms:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scored = []
        for (doc, _), own in zip(docs, terms, strict=True):
            score = 0
            for x in TERM.findall((text or "").translate(LOWER)):
                tf = own.count(x)
                if tf:
                    w = math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
                    score += w * (1000000000 * tf // (1000 * tf + 12 * (75 + 25 * len(own) * n // total)))
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def test_search_of_odd_documents(spark, odd_folder):
    folder, rows, items = odd_folder
    got = QUERIES["op12_ranked_search"](spark, folder).select("item_id", "rank", "doc_id", "score").collect()
    assert sorted(map(tuple, got), key=repr) == best([r[:2] for r in rows], items, 20)


@pytest.mark.parametrize("block, shard, cells", [(4096, 10**6, 1 << 20), (3, 50, 64)])
def test_search_finds_what_scoring_every_document_finds(spark, monkeypatch, block, shard, cells):
    chance = random.Random(7)
    vocabulary = [f"w{int(chance.paretovariate(0.6))}" for _ in range(400)]
    docs = [(k, " ".join(chance.choices(vocabulary, k=chance.randint(0, 40)))) for k in range(300)]
    docs += [(1000 + k, docs[5][1]) for k in range(60)]  # ties over the limit
    items = [(k, " ".join(chance.choices(vocabulary, k=chance.randint(1, 12)))) for k in range(9)] + [(77, docs[5][1])]
    monkeypatch.setattr(ranked, "SHARD", shard)
    monkeypatch.setattr(ranked, "CELLS", cells)
    monkeypatch.setattr("argweave.llm.common.SLICE_BYTES", 500)
    got = ranked.top_k(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), 7, block)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == best(docs, items, 7)


def test_range_maxima_are_those_of_a_scan():
    chance = np.random.default_rng(3)
    term, doc = np.divmod(np.sort(chance.choice(40 * 90, 700, replace=False)), 90)
    impact = chance.integers(1, 50, 700)
    shard = ranked.Shard(term, doc, impact, 40, 90)
    for _ in range(300):
        a, b = np.sort(chance.integers(0, 701, 2))
        b = min(b, np.searchsorted(term, term[min(a, 699)], "right"))
        at, most = shard.range_maxima(np.array([[a]]), np.array([[max(a, b)]]))
        assert most[0, 0] == (impact[a:b].max() if b > a else 0)
        assert b <= a or impact[at[0, 0]] == most[0, 0]


def test_search_splits_few_documents():
    """Only a part of the documents is scored."""
    chance = np.random.default_rng(5)
    docs, terms = 4000, 30
    key = np.flatnonzero(chance.random(docs * terms) < 0.1)
    shard = ranked.Shard(key // docs, key % docs, chance.integers(1, 1000, len(key)), terms, docs)
    seen = []
    bounded = shard._bounded
    shard._bounded = lambda a, b, times: (seen.append(len(a)), bounded(a, b, times))[1]
    found, scores = shard.search(np.arange(terms), np.ones(terms, np.int64), 20, 0)
    whole = np.bincount(shard.doc, shard.impact, docs).astype(np.int64)
    order = np.lexsort((np.arange(docs), -whole))[:20]
    assert found.tolist() == order.tolist() and scores.tolist() == whole[order].tolist()
    assert sum(seen) < docs


def near(texts: list[tuple], percent: int = 80) -> dict:
    """Component of each row by brute force, (n, least doc_id) by row."""
    sets = []
    for _, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(words)} if 0 < len(words) < 4 else {tuple(words[k : k + 4]) for k in range(len(words) - 3)})
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                old, new = root[a], root[b]
                root = [new if r == old else r for r in root]
    out = []
    for k, (doc, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if root[j] == root[k] and texts[j][0] is not None]
        least = min(ids) if ids else None
        out.append((doc, len(sets[k]), least, doc == least))
    return sorted(out, key=repr)


def test_near_duplicates_of_odd_documents(spark, odd_folder):
    folder, rows, _ = odd_folder
    got = QUERIES["op13_minhash_dedup"](spark, folder).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted(map(tuple, got), key=repr) == near([r[:2] for r in rows])


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_are_those_of_all_pairs(spark, monkeypatch, block):
    chance = random.Random(11)
    texts = []
    for family in range(14):
        base = [f"f{family}x{k}" for k in range(chance.randint(20, 60))]
        for _ in range(chance.randint(1, 14)):
            own = base[:]
            for _ in range(chance.randint(0, 3)):  # some pairs end below the limit, some chains just hold
                own[chance.randrange(len(own))] = f"n{chance.randrange(10**6)}"
            texts.append(" ".join(own) if chance.random() < 0.8 else " ".join(own).upper())
    chance.shuffle(texts)
    rows = [(1000 - k, t) for k, t in enumerate(texts)]
    monkeypatch.setattr(tensored, "BLOCK", block)
    got = tensored.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == near(rows)


def test_tensoring_computes_about_the_square_root():
    groups, rows = tensored.tensoring(0.8, 0.999)
    assert (1 - (1 - 0.8**rows) ** groups) ** 2 >= 0.999
    plain = math.ceil(math.log(1 - 0.999) / math.log(1 - 0.8 ** (2 * rows)))
    assert 2 * groups * rows < plain * 2 * rows / 2 and groups * groups >= plain


def test_places_choose_rows_in_the_pass_that_reads_them(spark, tmp_path):
    spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("x").alias("_file")).repartition(4).write.parquet(str(tmp_path / "d"))
    docs = places.placed(spark.read.parquet(str(tmp_path / "d")), "__")
    chosen = docs.where("doc_id % 7 = 0").select(F.col("__file").alias("file"), F.col("__row").alias("row"))
    for keep in (True, False):
        got = places.filtered(docs, chosen, keep, "__")
        assert sorted(r.doc_id for r in got.collect()) == [k for k in range(1000) if (k % 7 == 0) == keep]
    assert "Exchange" not in places.filtered(docs, chosen, True, "__")._jdf.queryExecution().executedPlan().toString()
    none = places.filtered(docs, chosen.where("false"), True, "__")
    assert none.count() == 0
    twice = chosen.select("file", "row", F.lit(1).alias("u")).unionByName(chosen.select("file", "row", F.lit(2).alias("u")))
    got = places.routed(docs, twice, lambda texts: {"size": pa.array([len(t) for t in texts.to_pylist()], pa.int64())}, "size long", "__")
    assert sorted((r.u, r.size) for r in got.collect()) == sorted((u, len(f"text {k}")) for u in (1, 2) for k in range(0, 1000, 7))


def test_groups_of_near_copies_hold_together_without_broadcasts(spark):
    """Each text is 0.8 like the one before it and less like others, so a link that is missed cuts its chain. Shuffled
    joins leave the keys of a class in any order."""
    chance = random.Random(3)
    rows = []
    for chain in range(4):
        words = [f"c{chain}x{k}" for k in range(120)]
        for step in range(60):
            rows.append((len(rows), " ".join(words)))
            words = words[13:] + [f"c{chain}y{step}z{k}" for k in range(13)]
    expected = {k: k - k % 60 for k in range(len(rows))}
    chance.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    settings = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in settings:
        spark.conf.set(name, "-1")
    try:
        got = {r.doc_id: r.component_id for r in tensored.near_duplicates(docs).collect()}
    finally:
        for name in settings:
            spark.conf.unset(name)
    assert got == expected


def test_classes_meet_in_the_tables_of_any_two_groups(spark):
    """Groups 14 and 20 are shared by 1 and 2, group 3 by 2 and 3, all others by none."""
    keys = {k: [1000 * k + g for g in range(22)] for k in (1, 2, 3)}
    for g, sharing in ((14, (1, 2)), (20, (1, 2)), (3, (2, 3))):
        for k in sharing:
            keys[k][g] = g
    classes = spark.createDataFrame(list(keys.items()), "id long, keys array<long>")
    got = tensored.buckets(classes, 11).select("id", "place", "size", "head").collect()
    assert sorted(map(tuple, got)) == [(1, 14 * 22 + 20, 2, 1), (2, 14 * 22 + 20, 2, 1)]
