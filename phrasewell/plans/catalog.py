"""The registered queries: every operator over the whole corpus (documents.text).

Queries that search read a stored index of the corpus, which the first of them
builds in the session's shared folder.  Positional and scoring queries use an
analyzer without stemming, so that their SQL doesn't depend on a stemmer;
stemming has queries of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..engine import Index
from ..functions import analysis
from ..functions.analysis import Analyzer
from ..functions.scoring import idf
from ..functions.stemmer import stemmed
from ..operators.expand import expand, looked_up, terms_table
from ..operators.phrase import candidates, intersect, intervals
from ..sources import ulid
from ..sources.store import Store
from ..sources.workdir import shared_dir
from ..streaming.ingest import delete_stream, ingest
from . import search as plans
from .query import build, parse

PLAIN = Analyzer(stem=False)
#: What the search queries look for; words of the corpus's invented languages.
TERM = "er"
PHRASE = '"er ntre"~0'
SLOP_PHRASE = '"er ntre anon"~{}'
REPEATED = '"de de"~3'
FUZZY_WORD = ("thble", 2)
FUZZY_PHRASE = '"er~1 ntre~1 onbleea~2"~2'
AUTO_FUZZY = "attion~ thanedble~ anea~"
ACCENTED = '"de la"~1'
TITLE = "The Attion, to thanedble"
BATCH_SLOP = 4
#: Corpora of fewer bytes are spread over the session's cores before they are analyzed.
SPREAD_BYTES = 64 << 20

_indexes: dict[tuple[str, str], Store] = {}


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # A small file may be one row group, which one core would read and analyze alone.
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    size = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return docs.repartition(spark.sparkContext.defaultParallelism, "doc_id") if size < SPREAD_BYTES else docs


def _key(id: Column) -> Column:
    """A number as a string that sorts as the number does: equal scores are ordered by id."""
    return F.lpad(id.cast("string"), 20, "0")


def _content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select(_key(F.col("doc_id")).alias("doc_id"), F.col("text").alias("content"))


def store(spark: SparkSession, sf_dir: str) -> Store:
    """The stored index of a corpus without stemming, built once in a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _indexes:
        made = Store(spark, f"{shared_dir(spark)}/index-{uuid.uuid4().hex}")
        made.append(_content(spark, sf_dir), PLAIN)
        _indexes[key] = made
    return _indexes[key]


def _fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _ids(df: DataFrame) -> DataFrame:
    """Stored ids are strings; the corpus's are numbers."""
    return df.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def _scored(df: DataFrame) -> DataFrame:
    return _ids(df).withColumn("score", F.round("score", 6))


def _search(spark: SparkSession, sf_dir: str, query: str, top_k: int = 0) -> DataFrame:
    found = plans.search(spark, store(spark, sf_dir).tables(), query, PLAIN, top_k)
    return _scored(found).select("doc_id", "score")


# Text analysis


def analyze_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.occurrences(corpus(spark, sf_dir), PLAIN)


def analyze_all_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segmentation and lower-casing alone: no stop words."""
    return analysis.occurrences(corpus(spark, sf_dir), Analyzer.of((), stem=False))


def analyze_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return analysis.occurrences(turns.select(F.concat_ws(":", "conv_id", "turn").alias("turn_id"), "text"), PLAIN, "turn_id").withColumnRenamed("doc_id", "turn_id")


def stem_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = analysis.occurrences(corpus(spark, sf_dir), PLAIN).select(F.col("token").alias("word")).distinct()
    return stemmed(words)


# Index tables


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analysis.postings(analysis.indexed(corpus(spark, sf_dir), PLAIN))
    return table.select("token", "doc_id", "tf", F.array_join("positions", " ").alias("positions"))


def stemmed_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = analysis.postings(analysis.indexed(corpus(spark, sf_dir)))
    return table.select("token", "doc_id", "tf", F.array_join("positions", " ").alias("positions"))


def document_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analysis.doc_stats(analysis.indexed(corpus(spark, sf_dir), PLAIN)).drop("tokens")


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).tables().vocab


def corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).corpus().select("n_docs", F.round("avg_doc_len", 6).alias("avg_doc_len"))


def inverse_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir).tables()
    return t.vocab.crossJoin(F.broadcast(t.corpus)).select("token", F.round(idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


# Search


def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, TERM)


def term_top_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, TERM, 10)


def exact_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, PHRASE)


def bare_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms without quotes are an exact phrase, too."""
    return _search(spark, sf_dir, "attion thanedble anea", 5)


def _slop(k: int) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _search(spark, sf_dir, SLOP_PHRASE.format(k))


def repeated_term_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, REPEATED)


def stop_words_leave_no_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, '"er the of ntre"')


def stop_words_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, "the of and")


def query_keeps_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are split at white space alone: "attion," isn't a word of any document, unless fuzzy."""
    return _search(spark, sf_dir, '"attion, thanedble"')


def _expanded(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    queries = plans.parse_all({"q": query}, PLAIN)
    vocab = looked_up(store(spark, sf_dir).tables().vocab, queries)
    return expand(terms_table(spark, queries), vocab).select("token", "df", "distance")


def fuzzy_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    word, fuzz = FUZZY_WORD
    return _expanded(spark, sf_dir, f"{word}~{fuzz}")


def short_token_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words no longer than the fuzziness stand for themselves alone."""
    return _expanded(spark, sf_dir, "er~2")


def fuzzy_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, FUZZY_PHRASE)


def fuzzy_top_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, FUZZY_PHRASE, 5)


def auto_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, AUTO_FUZZY)


def non_ascii_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, ACCENTED)


def title_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw title made into a phrase whose words may be one edit off: "attion,~1" finds "attion"."""
    return _search(spark, sf_dir, build(TITLE, 1, 1))


def phrase_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have each of a phrase's terms, whatever their order."""
    t = store(spark, sf_dir).tables()
    expanded = expand(terms_table(spark, plans.parse_all({"q": SLOP_PHRASE.format(0)}, PLAIN)), t.vocab)
    found = candidates(expanded, t.postings).withColumn("weight", F.lit(0.0))
    groups = intersect(found).select("doc_id", *[F.size(F.col("groups")[k]).alias(f"n_{k}") for k in range(3)])
    return _ids(groups)


def phrase_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each start's interval with its gaps, of a phrase of slop 3."""
    t = store(spark, sf_dir).tables()
    expanded = expand(terms_table(spark, plans.parse_all({"q": SLOP_PHRASE.format(3)}, PLAIN)), t.vocab)
    matched = intersect(candidates(expanded, t.postings).withColumn("weight", F.lit(0.0)))
    each = matched.select("doc_id", "slop", F.explode(intervals(F.col("groups"), F.col("n_terms"))).alias("x"), "n_terms")
    out = each.select("doc_id", "slop", F.col("x.first").alias("first"), F.col("x.last").alias("last"), (F.expr("x.last - x.first - n_terms + 1")).alias("gaps"))
    return _ids(out.where("last is not null and gaps <= slop").drop("slop"))


def score_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most that a document's best interval can score: each term's heaviest expansion, gaps aside."""
    t = store(spark, sf_dir).tables()
    queries = plans.parse_all({"q": FUZZY_PHRASE}, PLAIN)
    found = plans.weighted(expand(terms_table(spark, queries), looked_up(t.vocab, queries)), t)
    by_term = found.groupBy("doc_id", "term_idx", "n_terms").agg(F.max("weight").alias("w"))
    bound = by_term.groupBy("doc_id", "n_terms").agg(F.sum("w").alias("bound"), F.count("*").alias("n")).where("n = n_terms")
    return _ids(bound.select("doc_id", F.round("bound", 6).alias("bound")))


def hydrated_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = store(spark, sf_dir).tables()
    ranked = plans.search(spark, t, PHRASE, PLAIN, 5)
    return _scored(plans.hydrate(ranked, t.documents, 5)).select("doc_id", "score", "content")


def get_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ids(store(spark, sf_dir).live_documents().where(F.col("doc_id") == f"{7:020d}")).select("doc_id", "content")


def parsed_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = {"a": "Hello  World", "b": '"quick~ brown~1 fox~0"~12', "c": '  "x~ abc~ abcdef~" ', "d": "café~ faq?"}
    rows = [(k, i, t.text, t.fuzz, parse(q).slop) for k, q in texts.items() for i, t in enumerate(parse(q).terms)]
    return spark.createDataFrame(rows, "query_id string, term_idx int, text string, fuzz int, slop int")


def batch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's whole text as a phrase, all in one job."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = plans.phrases(spark, store(spark, sf_dir).tables(), items, "item_id", "text", BATCH_SLOP, PLAIN)
    return _scored(found).select(F.col("query_id").cast("bigint").alias("item_id"), "doc_id", "score")


def batch_top_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(batch_search(spark, sf_dir), 3)


def _top(found: DataFrame, k: int) -> DataFrame:
    # On rounded scores, so that equal ones are equal everywhere.
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


# Lifecycle


def _toxic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").select(_key(F.col("doc_id")).alias("doc_id"))


def _lifecycle(spark: SparkSession, sf_dir: str) -> Store:
    """Two batches are added, the toxic documents deleted."""
    made = Store(spark, _fresh(spark, "lifecycle"))
    docs = _content(spark, sf_dir)
    even = F.col("doc_id").cast("bigint") % 2 == 0
    made.append(docs.where(even), PLAIN)
    made.append(docs.where(~even), PLAIN)
    made.delete(_toxic(spark, sf_dir))
    return made


def _stored_search(spark: SparkSession, made: Store) -> DataFrame:
    return _scored(plans.search(spark, made.tables(), SLOP_PHRASE.format(2), PLAIN)).select("doc_id", "score")


def search_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_search(spark, _lifecycle(spark, sf_dir))


def search_after_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batches are rewritten without the deleted documents, and the index is opened anew."""
    made = _lifecycle(spark, sf_dir)
    made.merge(0.0, PLAIN)
    return _stored_search(spark, Store(spark, made.dir))


def vocabulary_after_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lifecycle(spark, sf_dir).tables().vocab.select("token", "df")


def session_of_ulids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added in bulk get ULIDs; the content is what was added."""
    index = Index(spark, _fresh(spark, "ulids"))
    with index.session():
        index.add_documents(_content(spark, sf_dir))
    live = index.store.live_documents()
    return live.select("content", (F.length("doc_id") == 26).alias("is_ulid"))


def streamed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus arrives as a stream of files, deletions as another."""
    index = Index(spark, _fresh(spark, "streamed"))
    index.analyzer = PLAIN
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    ingest(stream, index, _fresh(spark, "checkpoint"), content="text", once=True).awaitTermination()
    schema = spark.read.parquet(f"{sf_dir}/labels.parquet").schema
    gone = spark.readStream.schema(schema).option("pathGlobFilter", "labels.parquet").parquet(sf_dir).where("toxic = 1")
    delete_stream(gone, index, _fresh(spark, "checkpoint"), once=True).awaitTermination()
    return _stored_search(spark, index.store)


def stemmed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default analyzer: documents and query are stemmed alike."""
    docs = corpus(spark, sf_dir)
    found = plans.search(spark, plans.from_documents(docs), '"ering thly"~4')
    return _scored(found).select("doc_id", "score")


def ulid_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = corpus(spark, sf_dir).select("doc_id", ulid.column(F.col("doc_id"), 513, 1_700_000_000_000).alias("ulid"))
    return ids


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        analyze_documents, analyze_all_words, analyze_conversations, stem_vocabulary, postings, stemmed_postings, document_statistics,
        vocabulary, corpus_statistics, inverse_document_frequency, term_search, term_top_10, exact_phrase, bare_terms, repeated_term_phrase,
        stop_words_leave_no_gap, stop_words_only, query_keeps_punctuation, fuzzy_expansion, short_token_guard, fuzzy_phrase, fuzzy_top_5,
        auto_fuzzy, non_ascii_phrase, title_phrase, phrase_candidates, phrase_intervals, score_bounds, hydrated_results, get_document,
        parsed_queries, batch_search, batch_top_3, search_after_deletes, search_after_merge, vocabulary_after_deletes, session_of_ulids,
        streamed_search, stemmed_search, ulid_column,
    )
} | {f"phrase_slop_{k}": _slop(k) for k in range(4)}
