"""The pipeline on planted cases, and the registered queries on the driver tables."""

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

import __spark_entry__ as contract
from feedloom.llm.queries import ORACLES, QUERIES
from tests.conftest import SF_DIR
from tests.llm.conftest import prose
from tests.llm.test_exact import brute as brute_exact


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(400):
        rude = i % 5 == 0
        rows.append((i, f"the of and {prose(30, i * 13)}" + (" grobblex" if rude else ""), "en", "s", 1))
        labels.append((i, 0, int(rude)))
    rows += [
        (1000, rows[1][1] + " ", "en", "s", 1),
        (1001, rows[1][1].replace(" ", "  ", 3) + " ", "en", "s", 1),
        (1002, "grobblex " + prose(20, 7777), "en", "s", 1),
        (1003, prose(40, 4444), "en", "s", 1),
        (1004, None, "en", "s", 1),
        (1005, "", "en", "s", 1),
        (1006, prose(3000, 31), "en", "s", 1),
        (1007, prose(3000, 31) + " x1", "en", "s", 1),
        (None, prose(25, 99), None, None, None),
        (1003, "clean text that shares an id " + prose(15, 8), "en", "s", 1),
    ]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, prose(12, 4444))], "item_id bigint, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages_take_effect(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, left = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, tables)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        left.append(Counter(r["doc_id"] for r in docs.collect()))
    clean = {i for i in range(400) if i % 5}
    assert set(left[0]) == clean | {1000, 1001, 1003, 1004, 1005, 1006, 1007, None}
    assert set(left[1]) == clean | {1000, 1003, 1004, 1006, 1007, None} and left[1][1003] == 2
    assert set(left[1]) - set(left[2]) >= {1007} and clean - set(left[2]) == set()
    assert set(left[2]) - set(left[3]) == set() and left[3][1003] == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, tables).collect()
    assert Counter({r["doc_id"] for r in packed}) == Counter(set(left[3]))


def test_run_gives_pieces_of_kept_documents(spark, tables):
    rows = corpus_pipeline.run(spark, tables).collect()
    assert {r["doc_id"] for r in rows}.isdisjoint({0, 5, 1001, 1002, 1007})
    assert {1003, 1006, None} <= {r["doc_id"] for r in rows}


def test_repeated_rows_leave_one(spark, tables):
    docs = spark.createDataFrame([(1, "a  b", 1), (1, "a b", 1), (2, "a b", 2), (None, "n", 3), (None, "n", 3)], "doc_id bigint, text string, row_key int")
    rows = corpus_pipeline.exact_copies(spark, docs, tables).collect()
    assert sorted((r["doc_id"] or 0) for r in rows) == [0, 1]


def test_registered():
    assert set(QUERIES) <= set(contract.queries()) and "pipeline" in contract.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert set(ORACLES) <= set(QUERIES)


def test_exact_dedup_query_equals_brute_force(spark):
    rows = QUERIES["op5_exact_dedup"](spark, SF_DIR).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in rows)
    assert got == brute_exact(docs)[0]


def test_queries_equal_brute_force(spark):
    from tests.llm.test_contamination import brute as brute_hits
    from tests.llm.test_packing import brute as brute_pieces
    from tests.llm.test_pii import brute as brute_spans
    from tests.llm.test_simhash import mark
    from tests.llm.test_substrings import brute as brute_windows

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    run = {name: QUERIES[name](spark, SF_DIR).collect() for name in QUERIES if name not in ("op1_warc", "op4_lm", "op5_exact_dedup")}
    pieces = Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in run["op2_packing"])
    assert pieces == brute_pieces(docs, 1024)
    hits = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in run["op3_decontamination"])
    sha = lambda names: hashlib.sha256(",".join(names).encode()).hexdigest()
    assert hits == Counter((d, n, h, len(x), sha(x)) for d, n, h, x in brute_hits(docs, items).elements())
    windows = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run["op7_substrings"])
    assert windows == brute_windows(docs, 50)
    assert {r["doc_id"]: r["fingerprint"] for r in run["op8_simhash"]} == {d: f"{mark(t):016x}" for d, t in docs}
    base = {d: brute_spans(t or "") for d, t in docs}
    for r in run["op10_pii"]:
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for _, k, _ in base[r["doc_id"]]) for i in range(4)]
    assert len(run["op9_toxicity"]) == len(run["op6_idfiles"]) == len(docs)


def test_runs_query_equals_brute_force(spark):
    from tests.llm.test_runs import brute_row

    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = QUERIES["op12_runs"](spark, SF_DIR).collect()
    assert Counter(tuple(r) for r in rows) == Counter(brute_row(*d) for d in docs) and any(r["n_runs"] for r in rows)


def test_neighbours_query_finds_the_nearest(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()
    x = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in rows}
    got = {}
    for r in QUERIES["op13_neighbours"](spark, SF_DIR).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    assert sorted(got) == sorted(i for i in x if i % 100 == 0)
    best = {q: sorted((np.sqrt(((x[q] - v) ** 2).sum()), i) for i, v in x.items() if i != q)[:10] for q in got}
    assert sum(len(got[q] & {i for _, i in best[q]}) for q in got) >= 0.9 * sum(map(len, best.values()))
