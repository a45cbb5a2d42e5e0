"""Raw QA datasets -> corpus + ground truth, and corpus checks.

Raw rows are taken in *long* form, one row per (raw row, position, document
text) - the exploded form of a ``documents`` list - so no document list of
unbounded length is ever assembled in one task.

* ``ragbench_corpus``: content-addressed de-duplication.  Key = full md5 of
  the text (the 12-hex ``doc_`` id is exposed but 48 bits collide at scale);
  empty texts skipped; the first occurrence in (row, position) order wins.
  One hash aggregate with map-side partial aggregation, so a text repeated
  in a third of all rows is collapsed before the shuffle.
* ``ragbench_truth``: per raw row, the ids of its non-empty documents in order.
* ``scifact_corpus`` / ``scifact_truth``: sentence join + label priority +
  nested evidence, as array expressions per row (no shuffle).
* ``missing_support``: referenced ids absent from the corpus (anti-join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ragscope.functions.text import doc_id as content_id


def ragbench_corpus(raw_long: DataFrame, row_col: str = "row_id", pos_col: str = "pos",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, md5, text, first_row, first_pos, n_occurrences``."""
    docs = raw_long.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.md5(text_col).alias("md5"), F.col(row_col).alias("_row"), F.col(pos_col).alias("_pos"),
        F.col(text_col).alias("_text"))
    first = F.struct(F.col("_row"), F.col("_pos"))
    agg = docs.groupBy("md5").agg(
        F.min_by(F.struct("_row", "_pos", "_text"), first).alias("_first"),
        F.count(F.lit(1)).alias("n_occurrences"),
    )
    return agg.select(
        F.concat(F.lit("doc_"), F.substring("md5", 1, 12)).alias("doc_id"), "md5",
        F.col("_first._text").alias("text"), F.col("_first._row").alias("first_row"),
        F.col("_first._pos").alias("first_pos"), "n_occurrences")


def ragbench_truth_long(raw_long: DataFrame, row_col: str = "row_id", pos_col: str = "pos",
                        text_col: str = "text") -> DataFrame:
    """Supporting documents per raw row in long form: ``id, pos, doc_id``."""
    return raw_long.where(F.col(text_col).isNotNull() & (F.col(text_col) != "")).select(
        F.col(row_col).cast("string").alias("id"), F.col(pos_col).alias("pos"),
        content_id(F.col(text_col)).alias("doc_id"))


EVIDENCE = ("array<struct<doc_id:string,doc_title:string,sentences:array<struct<"
            "sentence_indices:array<int>,sentence_texts:array<string>,label:string>>>>")


def ragbench_truth(raw: DataFrame, id_col: str = "id", question: str = "question", response: str = "response",
                   documents: str = "documents") -> DataFrame:
    """Raw rows -> ground truth: the question as input, the response as expected response,
    the content ids of the row's non-empty documents in order, no label and no
    evidence.  One row in, one row out; other columns follow as they are."""
    rest = [c for c in raw.columns if c not in (id_col, question, response, documents)]
    texts = F.filter(F.coalesce(F.col(documents), F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != ""))
    return raw.select(
        F.col(id_col).cast("string").alias("id"), F.col(question).alias("input"), F.lit(None).cast("string").alias("expected_label"),
        F.col(response).alias("expected_response"), F.transform(texts, content_id).alias("supporting_documents"),
        F.array().cast(EVIDENCE).alias("evidence"), *rest)


def supporting_lists(truth_long: DataFrame) -> DataFrame:
    """``id, supporting_documents`` (ordered array) from the long form.  The
    list length is the number of documents of one raw row."""
    return truth_long.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "doc_id"))), lambda s: s["doc_id"])
        .alias("supporting_documents"))


def missing_support(truth_long: DataFrame, corpus: DataFrame, corpus_id: str = "doc_id") -> DataFrame:
    """Distinct referenced ids that the corpus does not hold."""
    ref = truth_long.select("doc_id").distinct()
    return ref.join(corpus.select(F.col(corpus_id).alias("doc_id")), "doc_id", "left_anti")


# --- SciFact-shaped sources -------------------------------------------------

def scifact_corpus(raw: DataFrame) -> DataFrame:
    """``doc_id int, title, abstract array<string>, structured`` ->
    ``id, text, title, structured, sentence_count``."""
    abstract = F.coalesce(F.col("abstract"), F.array().cast("array<string>"))
    return raw.select(
        F.col("doc_id").cast("string").alias("id"),
        F.array_join(abstract, " ").alias("text"),
        F.col("title"),
        F.coalesce(F.col("structured"), F.lit(False)).alias("structured"),
        F.size(abstract).alias("sentence_count"),
    )


def scifact_truth(raw: DataFrame) -> DataFrame:
    """Claims -> ground truth with label priority CONTRADICT > SUPPORT >
    (cited docs -> SUPPORT) > NOT_ENOUGH_INFO (a missing evidence label
    counts as SUPPORT) and evidence nested as document -> sentence groups."""
    ev = F.coalesce(F.col("evidences"), F.array())
    cited = F.transform(F.coalesce(F.col("cited_doc_ids"), F.array()), lambda d: d.cast("string"))
    label_of = lambda e: F.coalesce(e["label"], F.lit("SUPPORT"))
    has = lambda lab: F.exists(ev, lambda e: label_of(e) == lab)
    expected = (F.when(has("CONTRADICT"), "CONTRADICT").when(has("SUPPORT"), "SUPPORT")
                .when(F.size(cited) > 0, "SUPPORT").otherwise("NOT_ENOUGH_INFO"))
    evidence = F.transform(ev, lambda e: F.struct(
        e["doc_id"].cast("string").alias("doc_id"),
        F.lit(None).cast("string").alias("doc_title"),
        F.array(F.struct(
            F.coalesce(e["sentence_ids"], F.array().cast("array<int>")).alias("sentence_indices"),
            F.array().cast("array<string>").alias("sentence_texts"),
            label_of(e).alias("label"))).alias("sentences")))
    return raw.select(
        F.col("id").cast("string").alias("id"),
        F.col("claim").alias("input"),
        expected.alias("expected_label"),
        F.lit(None).cast("string").alias("expected_response"),
        cited.alias("supporting_documents"),
        evidence.alias("evidence"),
    )


def evidence_sentences(evidence_col: str = "evidence"):
    """All evidence sentence texts in order (documents, then sentence groups)."""
    return F.flatten(F.transform(
        F.coalesce(F.col(evidence_col), F.array()),
        lambda d: F.flatten(F.transform(d["sentences"], lambda s: s["sentence_texts"]))))


def evidence_for(evidence_col: str, doc):
    """The first evidence entry of one document, or null."""
    d = F.lit(doc) if isinstance(doc, str) else doc
    return F.get(F.filter(F.col(evidence_col), lambda e: e["doc_id"] == d), 0)


def normalize_truth(df: DataFrame) -> DataFrame:
    """Ground truth with the columns and types every reader expects.  Columns that
    were all null when written (Spark reads them as int or array<int>) become
    typed nulls or empty lists, missing ones are added, and extra columns stay."""
    out = df
    for c in ("input", "expected_label", "expected_response"):
        out = out.withColumn(c, F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string"))
    supporting = F.col("supporting_documents").cast("array<string>") if "supporting_documents" in df.columns else F.lit(None)
    out = out.withColumn("supporting_documents", F.coalesce(supporting, F.array().cast("array<string>")))
    if "evidence" not in df.columns or "struct" not in df.schema["evidence"].dataType.simpleString():
        out = out.withColumn("evidence", F.array().cast(EVIDENCE))
    return out.withColumn("id", F.col("id").cast("string"))


def _ragbench(raw_long: DataFrame) -> tuple[DataFrame, DataFrame]:
    truth = supporting_lists(ragbench_truth_long(raw_long))
    return ragbench_corpus(raw_long).select(F.col("doc_id").alias("id"), "text"), truth


def _scifact(raw: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    corpus, claims = raw
    return scifact_corpus(corpus), scifact_truth(claims)


# Dataset loaders by name: raw input -> (corpus, ground truth).
DATASET_LOADERS = {"ragbench": _ragbench, "scifact": _scifact}


def load_dataset(name: str, raw):
    try:
        loader = DATASET_LOADERS[name]
    except KeyError:
        raise ValueError(f"no loader is called {name!r} (have {sorted(DATASET_LOADERS)})") from None
    return loader(raw)
