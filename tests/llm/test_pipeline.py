"""The pipeline, stage by stage, on a small table."""

import os
import random
import subprocess
import sys

import pytest

import corpus_pipeline
from gristmill.llm import exact_dedup, queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    bench = [" ".join(r.text.lower().split()) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        if name == "packing":
            break
        kept = {r.doc_id for r in out.collect()}
        assert out.columns == columns and kept <= {r.doc_id for r in docs.collect()}
        if name == "exact_dedup":
            newest = {}
            for i in sorted(r.doc_id for r in docs.collect()):
                newest[rows[i]] = i
            assert kept == set(newest.values())
        if name == "decontaminate":
            leaks = {r.doc_id for r in docs.collect() if any(b in " ".join(r.text.lower().split()) for b in bench)}
            assert not kept & leaks and len(kept) >= 0.9 * (docs.count() - len(leaks))
        docs = out
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
    assert len(corpus_pipeline.STAGES) == 5


def small_table(spark, folder, rows):
    """A table of documents as sf_dir has it, with a benchmark of one item."""
    docs = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], docs).write.parquet(f"{folder}/documents.parquet")
    item = "the quick brown fox jumps over the lazy dog by the river bank today"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return item


def prose(rng, n):
    return " ".join("".join(rng.choice(["the", "ing", "er", "and", "on"]) for _ in range(3)) for _ in range(n))


def test_run_against_brute_force(spark, tmp_path):
    """The whole pipeline on planted cases: nulls, texts without letters, copies, near copies, a leak, repeated rows."""
    rng = random.Random(1)
    base = [prose(rng, 60) for _ in range(30)]
    near = base[0].split(" ")
    near[30] = "other"
    rows = [(i, t, "en") for i, t in enumerate(base)]
    rows += [(100, base[1], "en"), (101, " ".join(near), None), (102, None, "en"), (103, "", "en"), (104, "12 34", "en"), (None, base[2], "en"), (None, prose(rng, 50), "en"), (7, base[7], "en")]
    item = small_table(spark, tmp_path, [*rows, (105, base[3], "en"), (106, "x", "en")])
    leak = prose(rng, 30)
    extra = spark.createDataFrame([(107, f"{leak} {item} {leak}", "en", "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    extra.write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # the greatest doc_id of equal texts stays, then the least of near copies (0 and 101); no text, no letters and the leak go
    want = {*range(30), 100, 105, 106} - {1, 3}
    assert {r.doc_id for r in out if r.doc_id is not None} == want
    assert sum(r.doc_id is None for r in out) == 1 and len(out) == len(want) + 1
    assert all(r.piece == 0 and r.start == 0 for r in out)


def test_run_of_an_empty_table(spark, tmp_path):
    small_table(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    rng = random.Random(2)
    small_table(spark, tmp_path / "in", [(i, prose(rng, 30), "en") for i in range(12)])
    done, stages = [], corpus_pipeline.STAGES

    def watched(name, stage, fail):
        def run(spark, docs, sf_dir):
            if name == fail:
                raise RuntimeError(name)
            done.append(name)
            return stage(spark, docs, sf_dir)

        return run

    folder = f"file://{tmp_path}/work"
    for fail in ("decontaminate", None):
        monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, watched(n, f, fail)) for n, f in stages])
        if fail:
            with pytest.raises(RuntimeError):
                corpus_pipeline.run(spark, str(tmp_path / "in"), folder)
        else:
            assert corpus_pipeline.run(spark, str(tmp_path / "in"), folder).count() == 12
    assert done == [n for n, _ in stages]
    assert [p.name for p in (tmp_path / "work").iterdir()] == ["4-packing"]


def test_copies_are_found_without_python_workers(spark, monkeypatch):
    """What exact_dedup makes on the driver starts no Python worker of another kind on the executors, where it would stay."""
    made, create = [], type(spark).createDataFrame

    def watched(self, *args, **options):
        made.append(create(self, *args, **options))
        return made[-1]

    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, text string").localCheckpoint()
    monkeypatch.setattr(type(spark), "createDataFrame", watched)
    assert {r.doc_id for r in exact_dedup.keep_one(docs).collect()} == {2, 3}
    assert made and not any("PythonRDD" in df._jdf.queryExecution().toRdd().toDebugString() for df in made)


GIVES_BACK = """
import re
import pyarrow as pa
from gristmill.llm.common import small_batches

def held():
    return int(re.search(r"Anonymous: +(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batch(n):
    return pa.RecordBatch.from_arrays([pa.array(["x" * 100] * n)], ["text"])

def read(n):
    for b in small_batches(iter([batch(n)])):
        [str(i) * 20 for i in range(b.num_rows)]
        [pa.array([bytes(1000)]) for _ in range(b.num_rows)]

read(10)
before = held()
read(200_000)
print(held() - before)
"""


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="memory can't be read here")
def test_a_worker_gives_back_what_a_task_held():
    got = subprocess.run([sys.executable, "-c", GIVES_BACK], capture_output=True, text=True, check=True).stdout
    assert float(got) < 16
