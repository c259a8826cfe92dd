"""Jobs: two runs over growing input, interrupted runs, repeated ones, and the command line."""

import json
import os
import pathlib
import re
import shutil
import subprocess
import sys
import time

import pytest

from jobs import fulltext as indexing
from jobs import units as store
from jobs.queries import ORACLE_SQL, QUERIES
from sievework.functions.tokens import bm25_tokens
from sievework.sources import fulltext
from tests.compare import database, same

FOLDER = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).parents[1]
SCHEMA = "doc_id long, text string, term string, batch int, lang string, source string"


def put(spark, folder, name, rows):
    """One more file: (doc_id, text) rows, beside columns of clashing names."""
    path = f"{folder}-new-{name}"
    spark.createDataFrame([(k, t, "x", 7, "en" if (k or 0) % 2 else "fr", "s") for k, t in rows], SCHEMA).coalesce(1).write.parquet(path)
    os.makedirs(folder, exist_ok=True)
    for part in pathlib.Path(path).glob("part-*.parquet"):
        shutil.copy(part, f"{folder}/{name}.parquet")


def words(text):
    return re.findall(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*", (text or "").lower())


def plain(docs):
    """Postings of {doc_id: text}."""
    out = {}
    for k, t in docs.items():
        found = words(t)
        out[k, ""] = (len(found), [], len(found))
        for i, w in enumerate(found):
            tf, places, _ = out.get((k, w), (0, [], 0))
            out[k, w] = (tf + 1, [*places, i], len(found))
    return out


def indexed(spark, output, source):
    rows = indexing.read_index(spark, output, spark.read.parquet(source).schema["doc_id"]).collect()
    found = {(r["doc_id"], r["term"]): (r["tf"], r["positions"], r["length"]) for r in rows}
    assert len(found) == len(rows)
    return found


@pytest.fixture
def place(tmp_path):
    return str(tmp_path / "documents"), str(tmp_path / "index"), str(tmp_path / "checkpoint")


def test_index_grows_with_its_input(spark, place):
    source, output, checkpoint = place
    put(spark, source, "a", [(1, "one two one"), (2, None), (3, ""), (None, "no id")])
    done = indexing.run(spark, *place)
    assert done == {"batches": 1, "rows_read": 4, "rows_without_id": 1, "documents_written": 3, "postings_written": 2}
    assert indexed(spark, output, source) == plain({1: "one two one", 2: "", 3: ""})

    put(spark, source, "b", [(4, "two three"), (1, "another text of an id that is known"), (5, "b b"), (5, "a a")])
    done = indexing.run(spark, *place)
    assert (done["batches"], done["rows_read"], done["documents_written"]) == (1, 4, 2)
    whole = plain({1: "one two one", 2: "", 3: "", 4: "two three", 5: "a a"})
    assert indexed(spark, output, source) == whole

    before = sorted(str(p) for p in pathlib.Path(output).rglob("*.parquet"))
    assert indexing.run(spark, *place)["batches"] == 0
    assert before == sorted(str(p) for p in pathlib.Path(output).rglob("*.parquet"))


def test_index_in_many_batches(spark, place):
    source, output, checkpoint = place
    docs = {i: f"word{i % 7} shared term{i}" for i in range(30)}
    for part in range(5):
        put(spark, source, f"p{part}", [(i, t) for i, t in docs.items() if i % 5 == part])
    assert indexing.run(spark, *place, max_files=2)["batches"] == 3
    assert indexed(spark, output, source) == plain(docs)


def test_index_after_a_run_that_was_cut_off(spark, place):
    source, output, checkpoint = place
    put(spark, source, "a", [(1, "one two")])
    indexing.run(spark, *place)
    put(spark, source, "b", [(2, "two three"), (1, "known")])
    indexing.run(spark, *place)
    whole = indexed(spark, output, source)
    # The second micro-batch wrote part of its files, and isn't committed.
    for p in pathlib.Path(checkpoint, "commits").iterdir():
        if p.name.strip(".").split(".")[0] == "1":
            p.unlink()
    gone = next(pathlib.Path(output, "batch=1").rglob("part-*.parquet"))
    gone.unlink()
    assert indexed(spark, output, source) != whole
    assert indexing.run(spark, *place)["batches"] == 1
    assert indexed(spark, output, source) == whole == plain({1: "one two", 2: "two three"})


def test_index_after_a_failure_inside_a_batch(spark, place, monkeypatch):
    source, output, checkpoint = place
    put(spark, source, "a", [(1, "one two")])
    laid_out = fulltext.laid_out
    monkeypatch.setattr(fulltext, "laid_out", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(Exception, match="stopped"):
        indexing.run(spark, *place)
    monkeypatch.setattr(fulltext, "laid_out", laid_out)
    assert indexing.run(spark, *place)["documents_written"] == 1
    assert indexed(spark, output, source) == plain({1: "one two"})


def test_index_can_be_searched(spark, place):
    source, output, checkpoint = place
    put(spark, source, "a", [(1, "red apple pie"), (2, "apple red pie"), (3, "pear")])
    put(spark, source, "b", [(i, "filler text") for i in range(4, 12)])
    indexing.run(spark, *place)
    index = indexing.read_index(spark, output, spark.read.parquet(source).schema["doc_id"])
    asked = spark.createDataFrame([(0, ["red apple"]), (1, ["pear", "pie"])], "q int, phrases array<string>")
    found = [(r["q"], r["doc_id"], r["rank"]) for r in fulltext.search(index, asked, "q", "doc_id", 5, tokens=bm25_tokens).collect()]
    assert sorted(found) == [(0, 1, 1), (1, 1, 2), (1, 2, 3), (1, 3, 1)]


def units(spark, output):
    fields = "lang doc_id place unit source copies documents".split()
    return sorted((tuple(r[f] for f in fields) for r in spark.read.parquet(f"{output}/units").collect()), key=repr)


def test_units(spark, tmp_path):
    source, output = str(tmp_path / "documents"), str(tmp_path / "out")
    put(spark, source, "a", [(1, "Same line here. Own one."), (3, "same  LINE here.\nSame line here."), (2, "Same line here."), (None, "No id."), (4, None), (5, "")])
    whole = [("en", 1, 0, "Same line here.", "s", 3, 2), ("en", 1, 1, "Own one.", "s", 1, 1), ("fr", 2, 0, "Same line here.", "s", 1, 1)]
    done = store.run(spark, source, output)
    assert done == {"rows_read": 6, "rows_without_id": 1, "sentences": 5, "units_written": 3}
    assert units(spark, output) == sorted(whole, key=repr)
    assert store.run(spark, source, output) == done and units(spark, output) == sorted(whole, key=repr)
    report = {(r["lang"], r["source"]): (r["units"], r["sentences"]) for r in spark.read.json(f"{output}/report").collect()}
    assert report == {("en", "s"): (2, 4), ("fr", "s"): (1, 1)}

    put(spark, source, "b", [(7, "Later line."), (8, "Later French line.")])
    store.run(spark, source, output, langs="fr")  # the other language's partition stays
    assert units(spark, output) == sorted([*whole, ("fr", 8, 0, "Later French line.", "s", 1, 1)], key=repr)
    store.run(spark, source, output)
    assert units(spark, output) == sorted([*whole, ("fr", 8, 0, "Later French line.", "s", 1, 1), ("en", 7, 0, "Later line.", "s", 1, 1)], key=repr)


def test_units_of_an_empty_table_and_null_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert store.units_of(empty).count() == 0
    rows = spark.createDataFrame([(1, "A b.", None, None, None, None), (1, "A b.", None, None, None, None)], SCHEMA)
    assert [(r["lang"], r["source"], r["copies"], r["documents"]) for r in store.units_of(rows).collect()] == [(None, None, 2, 1)]


@pytest.mark.parametrize("slots", [1 << 18, 1])
def test_units_of_rows_that_share_an_id(spark, monkeypatch, slots):
    """Such rows are one document, also if all rows are taken for such."""
    monkeypatch.setattr(store, "SLOTS", slots)
    texts = [(1, "A b. C d.\na  B.", "en"), (1, "a b. E f.", "en"), (1, "A b.", "fr"), (2, "A b. E f. E f.", "en"), (3, "C d.", None), (3, "c d.\nC d.", None), (None, "A b.", "en")]
    rows = spark.createDataFrame([(k, t, "x", 7, lang, "s") for k, t, lang in texts], SCHEMA).repartition(3)
    found = {(r["lang"], r["unit"]): (r["doc_id"], r["place"], r["copies"], r["documents"]) for r in store.units_of(rows).collect()}
    assert found == {("en", "A b."): (1, 0, 4, 2), ("en", "C d."): (1, 1, 1, 1), ("en", "E f."): (1, 1, 3, 2), ("fr", "A b."): (1, 0, 1, 1), (None, "C d."): (3, 0, 3, 1)}


def test_units_texts_are_shuffled_once_and_no_shuffle_stays(spark, tmp_path):
    """They were three times, with keys of 64 characters, and a first run's stayed on disk while the second shuffled."""
    source, output = str(tmp_path / "documents"), str(tmp_path / "out")
    put(spark, source, "a", [(i, f"Same line here. Own line {i}.") for i in range(20)])
    plan = store.units_of(spark.read.parquet(source))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min(") == 1
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffles = lambda: {str(x) for x in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllBlocks()) if str(x).startswith("shuffle_")}
    before = shuffles()
    store.run(spark, source, output)
    for _ in range(50):  # they are removed by another thread
        if not shuffles() - before:
            break
        time.sleep(0.1)
    assert not shuffles() - before


@pytest.mark.parametrize("name, options", [("fulltext", {"output": "index", "checkpoint": "checkpoint"}), ("units", {"output": "out"})])
def test_command_line(spark, tmp_path, name, options):
    source = str(tmp_path / "documents")
    put(spark, source, "a", [(1, "One line here."), (2, "Another line.")])
    config = tmp_path / "config.json"
    config.write_text(json.dumps({"documents": "/nowhere", **{k: str(tmp_path / v) for k, v in options.items()}}))
    run = [sys.executable, "-m", f"jobs.{name}", "--config", str(config), "--documents", source]
    env = os.environ | {"PYTHONPATH": str(ROOT), "PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run(run, cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().split("\n")[-1])["rows_read"] == 2
    assert f"of {source}" in done.stderr


@pytest.mark.parametrize("name", ["fulltext", "units"])
def test_shipped_config_has_known_options(name):
    options = {"fulltext": indexing.OPTIONS, "units": store.OPTIONS}[name]
    config = json.loads((ROOT / "jobs" / f"{name}.json").read_text())
    assert set(config) <= set(options) and all(isinstance(v, options[k]) for k, v in config.items())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not there")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_equal_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), database(FOLDER), ORACLE_SQL[name])
