"""Every operator and stage on tables with nulls, repeats, ties, a very long text and columns with the operators' own names."""

import corpus_pipeline
import pytest
from palisade.llm import bpe, filter_audit, line_dedup, ngram_join, quality_cnn, quality_rules, source_divergence, suffix_dedup
from pyspark.sql import functions as F

CLASHING = "x_text x_ord x_tag x_gone m_id m_source m_size m_n m_copy r_id set_key g_key g_group g_least size node key label part fails id n copy".split()
DDL = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in CLASHING)
LABELS = "doc_id long, quality int, toxic int"


def nasty(spark):
    line = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    texts = [None, "", " \n\t", line, line, f"{line} x", f"{line}\n{line}", "a", "word " * 60_000, "\U0001f642 é\x00z"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(3, line, "en", "s")] * 3 + [(None, line, None, None), (None, None, None, None), (3, "other text", None, "s")]
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *range(len(CLASHING))) for r in rows], DDL)


LABELLED = [(i, i % 2, 0) for i in range(8)] + [(3, None, None), (None, 1, 1)]

OPERATORS = {
    "op1": lambda docs, labels: quality_rules.judge(docs),
    "op2": lambda docs, labels: ngram_join.near_duplicates(docs),
    "op3": lambda docs, labels: suffix_dedup.digest(docs),
    "op5": lambda docs, labels: quality_cnn.classify(docs, quality_cnn.train(docs, labels)),
    "op9": lambda docs, labels: line_dedup.summary(docs),
    "op10": lambda docs, labels: bpe.round_trip(docs),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_document(spark, name):
    docs, labels = nasty(spark), spark.createDataFrame(LABELLED, LABELS)
    assert OPERATORS[name](docs, labels).count() == docs.count()
    assert OPERATORS[name](docs.limit(0), labels).count() == 0


def test_audits(spark):
    docs, labels = nasty(spark), spark.createDataFrame(LABELLED, LABELS)
    assert filter_audit.audit(docs, labels).count() == 2 * 600
    assert source_divergence.audit(docs).groupBy("part").count().collect() == source_divergence.audit(docs.repartition(5)).groupBy("part").count().collect()


def test_stages(spark, tmp_path):
    """The stages one after the other; each but the last returns the columns of documents."""
    docs = nasty(spark)
    spark.createDataFrame(LABELLED, LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"stage{number}"))
            docs = nasty(spark) if number == 0 else spark.read.parquet(str(tmp_path / f"stage{number}"))
        else:
            assert out.count() == docs.count() > 0


def test_stages_without_documents(spark, tmp_path):
    docs = nasty(spark).limit(0)
    spark.createDataFrame([], LABELS).write.parquet(str(tmp_path / "labels.parquet"))
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() == 0
        docs = out.select(*docs.columns) if number < len(corpus_pipeline.STAGES) - 1 else docs


def test_lines_are_cut_once_whatever_the_columns(spark):
    docs = nasty(spark)
    cut = line_dedup.apply(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert cut.filter("text is null").count() == docs.filter("text is null").count()
    assert cut.agg(F.sum("x_text")).first()[0] == docs.agg(F.sum("x_text")).first()[0]
