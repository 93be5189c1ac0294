"""Registered queries of the engine's operators on the driver's tables.

Documents play the corpus (language as family, source as code), benchmark items the queries,
pages the laid-out print, conversations the answers.  Every query runs over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evidara.functions import text as tx
from evidara.functions.plan import union
from evidara.operators import answer, chunk, dense, evaluate, graph, ground, lexical, proximity, ranking, segment
from evidara.operators.inverted import InvertedIndex
from evidara.operators.mentions import mentions
from evidara.plans import analyze as plans
from evidara import schemas
from evidara.sources import store
from evidara.sources import tables as sources
from evidara.sources.tables import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

#: Parameters of the registered queries, shared with their SQL.
STAGES = (("contract", ("ation", "tionun")), ("award", ("keit", "schung")), ("tender", ("ciónes", "mente")), ("planning", ("que",)))
ROUTES = {"planeacion": ["tion", "ation", "ing"], "competencia-licitacion": ["ung", "keit", "sch"], "adjudicacion": ["eux", "ment", "oi"], "ejecucion-contrato": ["ción", "ñ", "rr"]}
MARKS, CODE_PATTERN = ("th", "an"), "[A-Z][a-z]{5,}"
VECTOR = [(i % 7 - 3) / 10.0 for i in range(64)]
LANG_FAMILY = {"en": "planeacion", "fr": "competencia/licitacion", "de": "adjudicacion", "es": "ejecucion/contrato"}
HEADER_LINES = list(segment.BLOCK_HEADERS)


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def corpus(spark: SparkSession, d: str, with_vectors: bool = False) -> DataFrame:
    """chunk_id, text, family and citation columns of every document."""
    docs = table(spark, d, "documents", spread=True)
    out = docs.select(F.col("doc_id").alias("chunk_id"), "text", F.col("lang").alias("family"), F.col("source").alias("indicator_code"), F.col("lang").alias("indicator_name"), F.lit(1).alias("page_start"), F.col("n_chars").cast("int").alias("page_end"))
    return dense.embed(out) if with_vectors else out


def items(spark: SparkSession, d: str, with_vectors: bool = False) -> DataFrame:
    out = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return dense.embed(out, "query") if with_vectors else out


_INDEXES: dict[tuple[str, str], str] = {}


def bm25_index(spark: SparkSession, d: str) -> InvertedIndex:
    """The stored index of the documents by language, built by the first query that asks and read by the others.

    It belongs to the files' names, sizes and times: changed documents get an index of their own.
    """
    key = spark.sparkContext.applicationId, store.stamp(table(spark, d, "documents"))
    if key in _INDEXES and store.exists(spark, f"{_INDEXES[key]}/about"):
        return InvertedIndex(spark, _INDEXES[key])
    _INDEXES[key] = store.new_path(spark, "bm25")
    return InvertedIndex.build(corpus(spark, d), _INDEXES[key], facet="family")


def units(spark: SparkSession, d: str) -> DataFrame:
    """Documents as units of the declared schema, with some gaps for the contract checks."""
    i = F.col("doc_id")
    kinds = F.array(*[F.lit(x) for x in ("core", "formula", "example", "core")])
    family = F.lit(None).cast("string")
    for k, v in LANG_FAMILY.items():
        family = F.when(F.col("lang") == k, v).otherwise(family)
    return table(spark, d, "documents").select(
        i.cast("string").alias("doc_id"), F.when(i % 4 != 0, (i - i % 4 + F.when(i % 20 == 5, 1).otherwise(0)).cast("string")).alias("parent_doc_id"), F.col("source").alias("source_file"), (i % 97).cast("int").alias("page_start"), (i % 97).cast("int").alias("page_end"),
        F.when(i % 5 == 0, "metodologia").otherwise("indicator").alias("section"), F.when(i % 33 == 7, "sidebar").otherwise(F.get(kinds, (i % 4).cast("int"))).alias("block_type"), family.alias("family"), F.lit(None).cast("string").alias("stage"), F.lit(None).cast("string").alias("indicator_code"),
        F.when(i % 50 != 1, F.concat(F.lit("unit "), i.cast("string"))).alias("indicator_name"), tx.md5_12(F.col("text")).alias("hash"), "text",
    )


def gold(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, relevant): documents that hold an item's whole text; items without any are kept."""
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"))
    docs = table(spark, d, "documents", spread=True).select("doc_id", "text")
    held = mentions(docs.select(F.col("doc_id").alias("src"), "text"), q.select(F.col("passage").alias("dst")))
    hits = held.join(q, F.col("dst") == F.col("passage")).select("query_id", F.col("src").alias("doc_id"))
    empty = q.where("passage = ''").select("query_id")
    if empty.limit(1).count():  # an empty text stands in every text
        hits = union(hits, docs.where("text is not null").select("doc_id").crossJoin(empty).select("query_id", "doc_id"))
    found = hits.groupBy("query_id").agg(F.sort_array(F.collect_set("doc_id")).alias("found"))
    return q.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("found", F.array().cast("array<bigint>")).alias("relevant"))


def print_pages(spark: SparkSession, d: str) -> DataFrame:
    return segment.pages_from_html(table(spark, d, "pages"))


def headed_pages(spark: SparkSession, d: str) -> DataFrame:
    """(page_num, full_text): page lines with a block header before every second one, in turn."""
    headers = F.array(*[F.lit(h.capitalize()) for h in HEADER_LINES])
    lines = F.transform("lines", lambda x, i: F.when(i % 2 == 1, F.concat(F.get(headers, F.floor(i / 2).cast("int") % len(HEADER_LINES)), F.lit("\n"), x["text"])).otherwise(x["text"]))
    return print_pages(spark, d).select("page_num", F.array_join(lines, "\n").alias("full_text"), "lines")


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Assistant turns as answers with the user turns before them as candidates."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'assistant'").select("conv_id", "turn", F.col("text").alias("answer"))
    u = c.where("role = 'user'").select("conv_id", F.col("turn").alias("u_turn"), F.col("text").alias("u_text"))
    pairs = a.select("conv_id", "turn").join(u, "conv_id").where("u_turn < turn")
    key = lambda x, y: F.concat_ws(":", x, y)
    cands = pairs.select(key("conv_id", "turn").alias("query_id"), F.col("u_turn").cast("int").alias("rank"), key("conv_id", "u_turn").alias("chunk_id"), F.col("u_text").alias("text"))
    return a.select(key("conv_id", "turn").alias("query_id"), "answer").join(answer.gather(cands), "query_id", "left")


@query
def unit_ids(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("ocp_unk_core_"), tx.md5_12(F.col("text"))).alias("unit_id"), tx.md5_12(F.col("text")).alias("hash"))


@query
def clean_text(s, d):
    c = table(s, d, "documents").select("doc_id", tx.clean_text(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("text_md5"))


@query
def page_lines(s, d):
    return print_pages(s, d).select("page_num", F.posexplode("lines").alias("pos", "l")).select("page_num", "pos", "l.text", "l.size")


@query
def page_titles(s, d):
    return print_pages(s, d).select("page_num", segment.title(F.col("lines")).alias("title"))


@query
def page_classify(s, d):
    p = print_pages(s, d)
    return p.select("page_num", segment.is_indicator(F.col("full_text"), MARKS, CODE_PATTERN).alias("is_indicator"), segment.code(F.col("full_text"), CODE_PATTERN).alias("code"), segment.code(F.col("full_text")).alias("r_code"))


@query
def stage_family(s, d):
    stage = segment.stage(F.col("text"), STAGES)
    return table(s, d, "documents").select("doc_id", stage.alias("stage"), segment.family(stage).alias("family"), segment.stage(F.col("text")).alias("default_stage"))


@query
def block_runs(s, d):
    b = headed_pages(s, d).select("page_num", F.posexplode(segment.blocks(F.col("full_text"))).alias("pos", "b"))
    return b.select("page_num", "pos", "b.kind", F.length("b.text").alias("n_chars"), F.md5(F.col("b.text").cast("binary")).alias("text_md5"))


@query
def indicator_units(s, d):
    u = segment.indicator_units(headed_pages(s, d), "pages")
    return u.select("doc_id", "parent_doc_id", "page_start", "block_type", "family", "stage", "indicator_code", "indicator_name", "hash")


@query
def section_split(s, d):
    return segment.methodology_units(print_pages(s, d), "pages").drop("text")


@query
def quality_report(s, d):
    return segment.quality_report(units(s, d))


@query
def family_distribution(s, d):
    return segment.distribution(units(s, d), "family")


@query
def contract_violations(s, d):
    return segment.violations(units(s, d))


@query
def orphan_parents(s, d):
    return segment.orphan_parents(units(s, d))


def _chunks(size: int, overlap: int):
    def run(s, d):
        c = chunk.chunk_units(table(s, d, "documents", spread=True).select("doc_id", "text"), size, overlap)
        return c.select("doc_id", "chunk_index", "char_offset", "n_chars", "chunk_id")

    return run


for _size, _overlap, _ in chunk.CONFIGS:
    QUERIES[f"chunks_{_size}_{_overlap}"] = _chunks(_size, _overlap)


@query
def chunk_contained_tails(s, d):
    return chunk.contained_tails(table(s, d, "documents", spread=True), 512, 64)


@query
def chunk_config_report(s, d):
    return chunk.compare_configs(table(s, d, "documents", spread=True).select("doc_id", "text"))


@query
def chunk_real_overlap(s, d):
    return chunk.overlaps(chunk.chunk_units(table(s, d, "documents", spread=True).select("doc_id", "text"), 512, 64))


@query
def vector_norms(s, d):
    return dense.norm_audit(table(s, d, "embeddings"))


@query
def vector_dim_check(s, d):
    return dense.dimension(table(s, d, "embeddings"))


@query
def hash_encoder(s, d):
    v = corpus(s, d, True).select("chunk_id", F.posexplode("embedding").alias("pos", "v")).where("v > 0")
    return v.select("chunk_id", "pos", F.bround("v", 6).alias("value"))


def _vectors(s, d):
    return table(s, d, "embeddings")


def _asks(s, d):
    return _vectors(s, d).select(F.col("vec_id").alias("query_id"), "embedding")


@query
def knn_single(s, d):
    q = s.range(1).select(F.lit(0).alias("query_id"), F.array(*[F.lit(x) for x in VECTOR]).alias("embedding"))
    return dense.search(q, _vectors(s, d), 10)


@query
def knn_batch(s, d):
    return dense.search(_asks(s, d), _vectors(s, d), 10)


@query
def knn_prefilter(s, d):
    return dense.search_filtered(_asks(s, d), _vectors(s, d), 5, "label", 3, "pre")


@query
def knn_postfilter(s, d):
    return dense.search_filtered(_asks(s, d), _vectors(s, d), 5, "label", 3, "post")


@query
def knn_unknown_ids(s, d):
    """Positions resolved to ids; each vector's position and one past the end."""
    v = _vectors(s, d).select("vec_id")
    pos = dense.positions(v, "vec_id")
    wanted = v.select((F.col("vec_id") * 2).alias("pos"))
    return dense.resolve(pos, wanted, "vec_id").select("pos", "vec_id")


@query
def knn_ivf_recall(s, d):
    exact = dense.search(_asks(s, d), _vectors(s, d), 10)
    return dense.recall(dense.InvertedFile(_vectors(s, d)).search(_asks(s, d), 10), exact)


@query
def knn_cells(s, d):
    """Exact neighbours by cells and their bounds."""
    return dense.Cells(_stored_file(s, _vectors(s, d), "vec_id")).search(_asks(s, d), 10)


@query
def dense_cells(s, d):
    """The same for items among the documents' vectors, which lie in groups."""
    cells = dense.Cells(_stored_file(s, corpus(s, d, True).select("chunk_id", "embedding"), "chunk_id"))
    return cells.search(items(s, d, True), 10)


def _stored_file(s, vectors, id):
    file = dense.InvertedFile(store.stored(vectors), id=id)
    file.save(store.new_path(s, "cells"))
    return file


@query
def knn_graph_recall(s, d):
    """The proximity graph asked for the ten nearest of every indexed vector: recall, and how many vectors a query scored.

    ``recall_reached`` is at least 0.95, ``few_scored`` at most 400 on average, a fifth of the vectors of sf0.1.
    """
    index = proximity.GraphIndex.build(_vectors(s, d)).save(store.new_path(s, "graph"))
    walks = store.stored(index.walks(_asks(s, d), 10, 10))
    r = proximity.walk_report(walks, dense.search(_asks(s, d), _vectors(s, d), 10), 10)
    return r.select("n", (F.col("recall") >= 0.95).alias("recall_reached"), (F.col("mean_scored") <= 400).alias("few_scored"))


@query
def bm25_postings(s, d):
    return lexical.postings(corpus(s, d))


@query
def bm25_idf(s, d):
    return lexical.term_idf(corpus(s, d)).withColumn("idf", F.bround("idf", 6))


@query
def bm25_topk(s, d):
    return bm25_index(s, d).search(items(s, d), 10)


@query
def bm25_family(s, d):
    return bm25_index(s, d).search(items(s, d), 10, "es")


@query
def topk_families(s, d):
    """Families among each query's best ten, and how many rows each has."""
    found = plans.candidates_of(bm25_index(s, d).search(items(s, d), 10), corpus(s, d))
    per = found.groupBy("query_id", "family").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("query_id").agg(F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"), F.max("n").alias("most"))


@query
def vector_documents(s, d):
    v = dense.payloads(corpus(s, d)).select("document.page_content", "document.metadata")
    return v.select(F.col("metadata.chunk_id").alias("chunk_id"), F.col("metadata.family").alias("family"), F.length("page_content").alias("n_chars"))


@query
def store_quick_query(s, d):
    """The vector store asked for each item's five nearest documents."""
    r = dense.quick_query(items(s, d), dense.vector_store(corpus(s, d)), 5)
    return r.select("query_id", "rank", F.col("document.metadata.chunk_id").alias("chunk_id"), F.col("document.metadata.family").alias("family"), F.length("document.page_content").alias("n_chars"))


@query
def route_keywords(s, d):
    r = ranking.route(F.col("query"), ROUTES)
    return items(s, d).select("query_id", F.array_join(r, ",").alias("families"))


@query
def route_fallback(s, d):
    return ranking.route_queries(items(s, d)).select("query_id", F.array_join("families", ",").alias("families"), "by")


def _legs(s, d, k):
    q, c = items(s, d, True), corpus(s, d, True)
    return bm25_index(s, d).search(q, k), dense.search(q, c, k, "chunk_id")


@query
def rrf_fusion(s, d):
    return ranking.rrf(*_legs(s, d, 30))


@query
def weighted_fusion(s, d):
    return ranking.weighted(*_legs(s, d, 30))


@query
def hybrid_topk(s, d):
    return ranking.hybrid(items(s, d, True), corpus(s, d, True), 10, index=bm25_index(s, d))


@query
def rerank_top5(s, d):
    r = plans.retrieve_and_rerank(items(s, d, True), corpus(s, d, True), index=bm25_index(s, d))
    return r.select("query_id", "chunk_id", "rank", "new_rank", "rerank_score")


@query
def rerank_movement(s, d):
    q, c = items(s, d, True), corpus(s, d, True)
    found = ranking.hybrid(q, c, 20, index=bm25_index(s, d))
    return ranking.rerank_movement(found, ranking.rerank(plans.candidates_of(found, c, q)))


def _bm25_candidates(s, d):
    c = corpus(s, d)
    return answer.gather(plans.candidates_of(bm25_index(s, d).search(items(s, d), 5), c))


@query
def context_string(s, d):
    c = _bm25_candidates(s, d).select("query_id", answer.context(F.col("candidates")).alias("c"))
    return c.select("query_id", F.length("c").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("context_md5"))


@query
def prompt_string(s, d):
    p = items(s, d).join(_bm25_candidates(s, d), "query_id").select("query_id", answer.prompt(F.col("query"), F.col("candidates")).alias("p"))
    return p.select("query_id", F.length("p").alias("n_chars"), F.md5(F.col("p").cast("binary")).alias("prompt_md5"))


@query
def template_answer(s, d):
    a = _bm25_candidates(s, d).select("query_id", answer.template_answer(F.col("candidates")).alias("answer"))
    return a.withColumn("is_safe", answer.is_safe(F.col("answer")))


@query
def sentence_split(s, d):
    x = table(s, d, "conversations").select("conv_id", "turn", F.posexplode(tx.sentences(F.col("text"))).alias("pos", "sentence"))
    return x


@query
def grounding_lexical(s, d):
    return ground.verify(answers(s, d))


@query
def grounding_ratio(s, d):
    a = answers(s, d)
    return ground.ratios(ground.verify(a), a)


@query
def grounding_summary(s, d):
    a = answers(s, d)
    return evaluate.grounding_summary(ground.ratios(ground.verify(a), a))


@query
def grounding_embedding(s, d):
    return ground.verify(answers(s, d), method="embedding")


@query
def mean_grounding(s, d):
    a = answers(s, d)
    return evaluate.mean_grounding(ground.ratios(ground.verify(a), a)).select(F.bround("mean_grounding_ratio", 6).alias("mean_grounding_ratio"))


@query
def askable_messages(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", answer.is_askable(F.col("text")).alias("askable"))


@query
def chat_texts(s, d):
    """Assistant turns as chat Markdown with made-up ratios, refusals and up to six citations of the turn itself."""
    c = table(s, d, "conversations").where("role = 'assistant'")
    n = (F.col("conv_id") + F.col("turn")) % 7
    cite = lambda i: F.struct(F.when(i % 3 != 0, F.concat(F.lit("R0"), i.cast("string"))).alias("indicator_code"), F.col("role").alias("indicator_name"), (i * 10).alias("page_start"), F.col("text").alias("sentence"))
    cited = F.when(n > 0, F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(n, F.lit(1).cast("long"))), cite)).otherwise(F.array())
    chat = answer.chat_text(F.col("text"), n / 8.0, F.when(n < 2, "no evidence").otherwise(""), cited)
    return c.select("conv_id", "turn", F.length(chat).alias("n_chars"), F.md5(chat.cast("binary")).alias("chat_md5"))


@query
def jsonl_round_trip(s, d):
    """Units written as JSON lines and read again with the declared schema."""
    path = store.new_path(s, "jsonl")
    sources.write_jsonl(units(s, d).select([f.name for f in schemas.UNITS]), path)
    back = sources.read_jsonl(s, path, schemas.UNITS)
    return back.select("doc_id", "parent_doc_id", "page_start", "section", "family", "indicator_name", "hash", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query
def index_round_trip(s, d):
    """Vectors saved by label and loaded again."""
    path = store.new_path(s, "vectors")
    sources.save_index(_vectors(s, d), path, "label")
    back = sources.load_index(s, path)
    return back.select("vec_id", F.col("label").cast("int").alias("label"), F.size("embedding").alias("dim"), F.bround(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 6).alias("total"))


@query
def citations(s, d):
    q, c = items(s, d), corpus(s, d)
    found = plans.candidates_of(bm25_index(s, d).search(q, 5), c)
    asked = q.select("query_id", F.col("query").alias("answer")).join(answer.gather(found), "query_id", "left")
    out = ground.citations(ground.verify(asked), c.withColumn("chunk_id", F.col("chunk_id").cast("string")))
    return out.select("query_id", "sent_pos", "chunk_id", "best_score", "indicator_code", "page_end")


@query
def analyze_batch(s, d):
    r = plans.analyze(items(s, d, True), corpus(s, d, True), index=bm25_index(s, d))
    a = r["answers"].select("query_id", F.md5(F.col("answer").cast("binary")).alias("answer_md5"))
    return r["ratios"].join(a, "query_id")


def _gold_lists(s, d):
    a, b = (store.stored(leg) for leg in _legs(s, d, 10))  # each feeds two lists
    as_code = lambda x: x.select("query_id", "rank", F.col("chunk_id").alias("code"))
    return {"bm25": as_code(a), "dense": as_code(b), "hybrid": as_code(ranking.rrf(a, b))}


@query
def compare_methods(s, d):
    return plans.evaluate_methods(_gold_lists(s, d), gold(s, d))


def _bm25_recall(s, d):
    lists = evaluate.ordered_codes(bm25_index(s, d).search(items(s, d), 10).withColumnRenamed("chunk_id", "code"))
    j = gold(s, d).join(lists, "query_id", "left")
    return j.select("query_id", F.size("relevant").alias("n_relevant"), F.bround(evaluate.recall_at(F.col("codes"), F.col("relevant"), 5), 4).alias("recall"), F.bround(evaluate.precision_at(F.col("codes"), F.col("relevant"), 5), 4).alias("precision"))


@query
def recall_precision(s, d):
    return _bm25_recall(s, d)


@query
def best_worst(s, d):
    return evaluate.best_and_worst(_bm25_recall(s, d))


@query
def gold_validity(s, d):
    """Gold codes that the labelled part of the corpus lacks."""
    labelled = table(s, d, "labels").select(F.col("doc_id").alias("code"))
    return evaluate.unknown_gold(gold(s, d), labelled)


def _answer_pairs(s, d):
    """Assistant turns, each with the turn before it as the reference."""
    c = table(s, d, "conversations")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return c.withColumn("before", before).where("role = 'assistant' and before is not null")


@query
def rouge_bleu(s, d):
    bleu = F.bround(evaluate.bleu("text", "before"), 4)
    return _answer_pairs(s, d).select("conv_id", "turn", evaluate.rouge_l("text", "before").alias("rouge_l"), bleu.alias("bleu"))


@query
def bleu_scores(s, d):
    return _answer_pairs(s, d).select("conv_id", "turn", F.bround(evaluate.bleu("text", "before"), 4).alias("bleu"))


@query
def bleu_mean(s, d):
    return evaluate.mean_bleu(_answer_pairs(s, d), "text", "before")


def _host_pages(s, d):
    """Every page as a file named like its host."""
    return table(s, d, "pages").select(F.regexp_extract("url", "//([^/?#]+)", 1).alias("path"), F.col("html").alias("text"))


@query
def ref_graph_edges(s, d):
    return graph.edges(_host_pages(s, d))


@query
def ref_graph_orphans(s, d):
    f = _host_pages(s, d)
    return graph.orphans(f.select("path").distinct(), graph.edges(f))


def _linked_pages(s, d):
    """Pages as files: two of three name the url of the page after them and of the one at twice their place."""
    p = table(s, d, "pages")
    url = lambda i: F.coalesce(F.concat(F.lit(" "), F.col(i)), F.lit(""))
    other = p.select(F.col("page_id").alias("i"), F.col("url").alias("u"))
    nxt, far = other.select((F.col("i") - 1).alias("page_id"), F.col("u").alias("next_url")), other.where("i % 2 = 0").select((F.col("i") / 2).cast("long").alias("page_id"), F.col("u").alias("far_url"))
    own = p.join(nxt, "page_id", "left").join(far, "page_id", "left")
    said = F.when(F.col("page_id") % 3 != 0, F.concat(url("next_url"), url("far_url"), F.lit("."))).otherwise("")
    return own.select(F.col("url").alias("path"), F.concat(F.coalesce("html", F.lit("")), said).alias("text"))


@query
def ref_page_edges(s, d):
    return graph.edges(_linked_pages(s, d))


@query
def ref_page_orphans(s, d):
    f = store.stored(_linked_pages(s, d))
    return graph.orphans(f, graph.edges(f))


@query
def file_kinds(s, d):
    p = table(s, d, "pages").select("page_id", F.concat(F.element_at(F.array(*[F.lit(x) for x, _ in graph.KIND_BY_PREFIX]), (F.col("page_id") % len(graph.KIND_BY_PREFIX) + 1).cast("int")), "url").alias("path"))
    return p.groupBy(graph.kind_of(F.col("path")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _tasks(s, d):
    n = table(s, d, "nation")
    dep = n.select((F.col("n_nationkey") + 1).alias("n_nationkey"), F.col("n_name").alias("dep"))
    r = table(s, d, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("owner_cli"))
    t = n.join(r, "n_regionkey").join(dep, "n_nationkey", "left")
    return t.select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("pos"), "owner_cli", F.when(F.col("n_nationkey") % 3 == 0, "done").otherwise("todo").alias("status"), F.when(F.col("dep").isNull(), F.array().cast("array<string>")).otherwise(F.array("dep")).alias("depends_on"))


@query
def ready_tasks(s, d):
    return graph.ready_tasks(_tasks(s, d)).select("id", "pos", "owner_cli")


def entry(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("source").alias("indicator_code"))
    return plans.evidence_for_items(docs, items(spark, d))
