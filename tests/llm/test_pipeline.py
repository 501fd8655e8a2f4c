import re
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as spark_entry
import corpus_pipeline
from stewardry.llm import content_sort, jaccard, langid, toxicity
from stewardry.llm.frames import table
from test_packing import check


IN_SQL = ["op2_chat", "op8_warc_revisits", "op10_exact_dedup", "op11_prefix_trie", "op13_lexical_search"]


def test_stages_one_after_another(spark, sf_dir):
    docs = start = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == start.columns and out.dtypes == start.dtypes
        before = {r.doc_id: r for r in docs.collect()}
        after = out.collect()
        assert all(before[r.doc_id] == r for r in after)
        seen[name] = (before, {r.doc_id for r in after})
        docs = spark.createDataFrame(after, start.schema)
        if name == "toxicity":
            scored = toxicity.score(start, toxicity.learn(start, labels)).collect()
            assert seen[name][1] == {r.doc_id for r in scored if r.predicted == 0}
        elif name == "language":
            source = spark.createDataFrame(list(before.values()), start.schema)
            found = langid.identify(source, langid.learn(source)).collect()
            assert seen[name][1] == {r.doc_id for r in found if not r.rejected}
        elif name == "exact_dedup":
            best = {}
            for r in before.values():
                norm = re.sub("[\x20\x09-\x0d]", "", r.text or "")
                best[norm] = min(best.get(norm, (1, 0)), (-len(r.text or ""), r.doc_id))
            assert seen[name][1] == {i for _, i in best.values()}
        else:
            source = spark.createDataFrame(list(before.values()), start.schema)
            groups = Counter(r.component_id for r in jaccard.jaccard_components(source).collect())
            assert seen[name][1] == set(groups)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    ran = corpus_pipeline.run(spark, sf_dir)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for pieces in (packed.collect(), ran.collect()):
        assert check(docs, pieces, tokenizer) <= 0.005 * sum(p.length for p in pieces)


@pytest.mark.parametrize("nth", range(5))
def test_stages_take_odd_and_no_rows(spark, sf_dir, odd, nothing, nth):
    stage = corpus_pipeline.STAGES[nth][1]
    # labels are read from the folder
    out = stage(spark, odd, sf_dir)
    out.collect()
    assert stage(spark, nothing, sf_dir).count() == 0


def test_registered():
    names = [n for n in spark_entry.queries() if n == "pipeline" or re.match(r"op\d+_", n)]
    assert len(names) == 14
    assert set(IN_SQL) <= set(spark_entry.oracle_sql())


@pytest.mark.parametrize("name", IN_SQL)
def test_against_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = spark_entry.queries()[name](spark, sf_dir)
    cursor = con.execute(spark_entry.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(repr(r) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(columns).collect()) == want and want


def test_no_lineage_to_executors(spark, corpus):
    """Intermediate results are files in the shared folder."""
    out = content_sort.exact_groups(corpus)
    plan = out._jdf.queryExecution().toString()
    assert "llm-sorted" in plan and out.filter(F.col("kept")).count() > 0
