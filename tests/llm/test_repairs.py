"""Texts and rules that once ended a job, plans without texts in a shuffle, and functions on workers without the package."""

from __future__ import annotations

import re
import subprocess
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from argweave.llm import jaccard, packing, pieces, urls, wrappers
from argweave.llm.eliasfano import EliasFano, encode


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + "\n" * 1_000_421 + "b"], ids=["spaces", "line feeds"])
def test_packing_takes_long_runs_of_white_space(text):
    encoder = packing.Encoder(packing.vocabulary_path())
    assert encoder.ids(text).tolist() == encoder.exact.encode(text, add_special_tokens=False).ids


def test_pieces_take_more_code_points_than_16_bits_hold(monkeypatch):
    model = pieces.Vocabulary(pieces.model_path())
    letters = [chr(c) for c in range(0x100, 0x19000) if not 0xD800 <= c < 0xE000 and chr(c) not in "▁"]
    units = ["▁" + "".join(letters[k : k + 50]) for k in range(0, len(letters), 50)] + ["▁the", "▁house", "x"]
    whole = model._encode_group(units)
    monkeypatch.setattr(pieces, "GROUP", 1000)
    parts = model.encode_units(units)
    assert len(set("".join(units))) > 65_534
    assert whole[0].tolist() == parts[0].tolist() and whole[1].tolist() == parts[1].tolist()


def test_unknown_verdicts_are_refused(spark):
    pages = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    for verdict in ("maybe", None):
        with pytest.raises(ValueError, match="must be one of"):
            urls.judge(pages, spark.createDataFrame([("net/", verdict)], "rule string, verdict string"))


def test_pages_are_read_on_workers_without_the_package(tmp_path):
    (tmp_path / "f").write_bytes(cloudpickle.dumps(wrappers.parse))
    run = "import pickle, sys; sys.path = [p for p in sys.path if p]; print(pickle.load(open('f', 'rb'))('<div class=nav><p>x</p></div>').tag)"
    done = subprocess.run([sys.executable, "-c", run], cwd=tmp_path, env={"PATH": "/usr/bin"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0 and done.stdout.strip() == "html", done.stderr


def test_jaccard_join_shuffles_no_text(spark, tmp_path, monkeypatch):
    """With broadcasts off every join is a shuffle; the document's other columns stay in the pass that reads them."""
    rows = [(k, " ".join(f"w{j}" for j in range(k % 9, 60 + k % 9)), f"payload{k}") for k in range(80)]
    spark.createDataFrame(rows, "doc_id long, text string, payload string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    seen = []
    for name in ("placed", "routed", "filtered"):
        function = getattr(jaccard, name)
        monkeypatch.setattr(jaccard, name, lambda *a, f=function, **b: (seen.append(f(*a, **b)), seen[-1])[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = jaccard.keep_one(docs)
        assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in kept.collect()) == [0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(seen) == 3
    for df in seen:
        for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
            assert not ("Exchange" in line and re.search(r"\b(text|payload)#", line))


def test_kept_row_of_repeated_rows_is_one(spark):
    rows = [(5, "a b c d e f g"), (5, "a b c d e f g"), (7, "a b c d e f g"), (None, "a b c d e f g"), (None, None), (None, None), (9, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, jaccard.keep_one(docs).collect()), key=repr) == sorted([(5, "a b c d e f g"), (None, None), (None, None), (9, "")], key=repr)
    assert np.unique([r.class_id for r in jaccard.join(docs).collect() if r.class_id is not None]).tolist() == [5, 9]


@pytest.mark.parametrize(("most", "n"), [(1, 1), (1, 5000), (300, 5000), (10**6, 5000), (2**62, 3000), (64, 64)])
def test_elias_fano_finds_and_reads_every_number(most, n):
    values = np.sort(np.random.default_rng(n).integers(0, most, n, dtype=np.uint64))
    sequence = EliasFano(np.frombuffer(encode(values), np.uint8))
    assert (sequence.access(np.arange(n)) == values).all()
    asked = np.unique(np.concatenate((values, values + np.uint64(1), np.random.default_rng(0).integers(0, most, 500, dtype=np.uint64))))
    place = np.searchsorted(values, asked)
    there = (place < n) & (values[np.minimum(place, n - 1)] == asked)
    assert (sequence.find(asked) == np.where(there, place, -1)).all()
