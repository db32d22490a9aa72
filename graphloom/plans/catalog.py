"""Every query by name: the operators applied to the test tables, and the SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import chat, chunking, experiment, graph, ranking, triples, vectors, viz
from graphloom.plans import graphs, oracles
from graphloom.sources import sinks, tables
from graphloom.sources.tables import table
from graphloom.storage import fresh_path, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = oracles.SQL


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- text and sources ---


@query
def clean_corpus(spark, d):
    return table(spark, d, "documents").select("doc_id", fn.clean(F.col("text")).alias("cleaned"))


@query
def dehyphenate(spark, d):
    broken = F.replace(F.col("text"), F.lit(" of "), F.lit(" o-\nf "))
    return table(spark, d, "documents").select("doc_id", fn.clean(broken, dehyphenate_first=True).alias("cleaned"))


@query
def document_text_from_pages(spark, d):
    return tables.document_text(table(spark, d, "conversations"), "conv_id", "turn", F.col("text"))


@query
def page_range_scan(spark, d):
    rows = tables.page_range(table(spark, d, "conversations"), "turn", "text", 2, 5)
    return rows.select("conv_id", fn.page_label(F.col("turn")).alias("page"), F.length("text").cast("long").alias("n_chars"))


@query
def question_scan(spark, d):
    return graphs.questions(spark, d).select("query_id", "question", F.substring("question", 1, 50).alias("shown"))


def _chunks(spark, d):
    return chunking.chunk_fixed(table(spark, d, "documents"), "doc_id", fn.clean(F.col("text")))


@query
def chunk_fixed(spark, d):
    return _chunks(spark, d)


@query
def chunk_ids(spark, d):
    return chunking.chunk_numbers(_chunks(spark, d), "doc_id").select("doc_id", "chunk_pos", "chunk_id", F.length("chunk").cast("long").alias("n_chars"))


@query
def chunk_counts(spark, d):
    return chunking.chunk_counts(_chunks(spark, d), "doc_id", 5)


@query
def chunk_recursive(spark, d):
    return chunking.chunk_recursive(table(spark, d, "documents"), "doc_id", fn.clean(F.col("text")))


@query
def chunk_recursive_graph(spark, d):
    return chunking.chunk_recursive(table(spark, d, "documents"), "doc_id", F.col("text"), 1000, 150, chunking.GRAPH_SEPARATORS)


# --- triples ---


@query
def extract_triples(spark, d):
    return triples.extract_sentences(table(spark, d, "documents"), "doc_id", F.col("text")).select("doc_id", "item", "source", "relation", "target")


@query
def parse_triples_json(spark, d):
    events = table(spark, d, "events")
    reply = F.concat(F.lit('{"triples":[{"source":"'), "event_type", F.lit('","relation":"has k","target":"'), F.get_json_object("props", "$.k"), F.lit('"}'), F.when(F.col("event_id") % 7 == 0, F.lit("")).otherwise(F.lit("]}")))
    return triples.parse_replies(events, "event_id", reply).select("event_id", "source", "relation", "target", "description")


@query
def validate_entities(spark, d):
    names = [("nation", "n_name"), ("region", "r_name"), ("supplier", "s_name"), ("customer", "c_name"), ("part", "p_name"), ("part", "p_type"), ("part", "p_brand")]
    rows = None
    for t, c in names:
        one = table(spark, d, t).select(F.col(c).alias("name")).distinct()
        rows = one if rows is None else rows.union(one)
    return rows.distinct().select("name", fn.valid_entity(F.col("name")).alias("valid"))


@query
def normalize_triples(spark, d):
    edges, _ = triples.normalise(graphs.sentences(spark, d))
    return edges.select("doc_id", "item", "src", "rel", "dst", F.col("file").alias("source"), "page")


@query
def quarantine_triples(spark, d):
    _, bad = triples.normalise(graphs.sentences(spark, d))
    return bad.select("doc_id", "item", "source", "target")


@query
def upsert_edges(spark, d):
    writes = graphs.g2_writes(spark, d)
    cut = F.col("seq.doc_id") % 2 == 0
    first = graph.collapse(writes.where(cut), F.col("seq")).drop("seq")
    out = graph.upsert_edges(first.withColumn("seq", F.lit(None).cast("struct<doc_id: bigint, item: int>")), writes.where(~cut), F.col("seq"))
    return out.select("src", "rel", "dst", "description", "source", "page")


@query
def ingest_counts_by_chunk(spark, d):
    """Triples written for each chunk, 0 where none is usable."""
    chunks = chunking.chunk_fixed(table(spark, d, "documents"), "doc_id", fn.clean(F.col("text")), 1000, 150)
    chunks = chunks.select(F.struct("doc_id", "chunk_pos").alias("place"), "chunk")
    edges, bad = triples.normalise(triples.extract_sentences(chunks, "place", F.col("chunk")))
    rows = edges.select("place", F.lit(1).alias("n")).unionByName(bad.select("place", F.lit(0).alias("n")))
    return rows.groupBy("place").agg(F.sum("n").alias("n_written")).select("place.doc_id", "place.chunk_pos", "n_written")


@query
def ingest_counts(spark, d):
    writes = graphs.g2_writes(spark, d)
    return writes.groupBy(F.col("seq.doc_id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_written"))


# --- graph ---


@query
def graph_stats(spark, d):
    edges = graphs.g1(spark, d)
    return graph.stats(graph.vertices(edges), edges)


@query
def graph_stats_no_edges(spark, d):
    edges = graphs.g1(spark, d)
    return graph.stats(graph.vertices(edges), edges.where("rel = 'NONE'"))


@query
def edge_scan(spark, d):
    return graph.sample_edges(graphs.g2(spark, d), 400)


@query
def node_degrees(spark, d):
    return graph.degrees(graph.sample_edges(graphs.g1(spark, d), 400))


@query
def node_degrees_text(spark, d):
    return graph.degrees(graphs.g2(spark, d))


@query
def keyword_fallback(spark, d):
    rows = graph.keyword_rows(graphs.questions(spark, d), "query_id", fn.fallback_keywords(F.col("question")))
    return rows.select("query_id", "pos", "keyword")


@query
def keyword_parse(spark, d):
    said = F.regexp_replace("question", " ", ",")
    rows = graph.keyword_rows(graphs.questions(spark, d), "query_id", fn.parse_keywords(said))
    return rows.select("query_id", "pos", "keyword")


@query
def keyword_engine(spark, d):
    """Replies of the engine's model, of which every third failed."""
    said = F.when(F.col("query_id") % 3 != 0, F.regexp_replace("question", " ", ","))
    rows = graph.keyword_rows(graphs.questions(spark, d), "query_id", fn.engine_keywords(said))
    return rows.select("query_id", "pos", "keyword")


@query
def keyword_parse_dashboard(spark, d):
    said = F.when(F.col("query_id") % 2 == 0, F.regexp_replace("question", " ", ",")).otherwise(F.lit(",a,"))
    rows = graph.keyword_rows(graphs.questions(spark, d), "query_id", fn.keywords_or_fallback(said, F.col("question")))
    return rows.select("query_id", "pos", "keyword")


def _g1_seeds(spark, d):
    edges = graphs.g1(spark, d)
    return edges, graph.seeds(graph.vertices(edges), graphs.asked(spark))


@query
def seed_match(spark, d):
    return _g1_seeds(spark, d)[1]


@query
def seed_pairs(spark, d):
    seeds = _g1_seeds(spark, d)[1]
    a = seeds.where("pos = 0").select("query_id", F.col("id").alias("a"))
    b = seeds.where("pos = 1").select("query_id", F.col("id").alias("b"))
    return a.join(b, "query_id").where("a <> b")


@query
def neighbors_limit(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    near = graph.neighbours(edges, seeds, 10)
    return near.select("query_id", "pos", fn.render(F.col("src"), F.col("rel"), F.col("dst")).alias("triplet"))


@query
def neighbors_oriented(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    return graph.neighbours(edges, seeds, None, oriented=True).select("query_id", "pos", "src", "rel", "dst")


@query
def khop_edges(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    return graph.k_hop_edges(edges, seeds, 150)


@query
def khop_rendered(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    about = F.when(F.col("rel") == "SUPPLIES", F.concat(F.lit("sold by "), F.lower("src")))
    text = fn.render_with_context(F.col("src"), F.col("rel"), F.col("dst"), about)
    return graph.k_hop_edges(edges, seeds, 150).select("query_id", text.alias("triplet"))


@query
def shortest_path_dist(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    return graph.shortest_paths(edges, seeds).select("query_id", "origin", "target", F.col("hops").cast("long").alias("hops"))


@query
def shortest_path_edges(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    found = graph.shortest_paths(edges, seeds)
    steps = F.transform("path", lambda e: fn.render(e["src"], e["rel"], e["dst"]))
    return found.select("query_id", "origin", "target", F.array_join(steps, "; ").alias("path"))


@query
def candidate_union(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    return graph.candidates(graph.shortest_paths(edges, seeds), graph.neighbours(edges, seeds, 10))


# --- ranking ---


def _ranked(spark, d, k=12, values=()):
    asked = graphs.questions(spark, d)
    edges = graphs.g2(spark, d, store=True)
    words = graph.keyword_rows(asked, "query_id", F.array_distinct(fn.fallback_keywords(F.col("question"))))
    near = graph.neighbours(edges, graph.seeds(graph.vertices(edges), words), 10)
    found = near.select("query_id", fn.render(F.col("src"), F.col("rel"), F.col("dst")).alias("triplet"), "src", "rel", "dst")
    return ranking.rerank(asked, found, k, values)


@query
def rerank_topk(spark, d):
    return _ranked(spark, d)


@query
def triplet_rows(spark, d):
    """The edge of each ranked text, which highlights follow from."""
    return _ranked(spark, d, 15, ("src", "rel", "dst")).select("query_id", "rank", "triplet", "src", "rel", "dst")


@query
def rerank_topk_dashboard(spark, d):
    return _ranked(spark, d, 15)


@query
def context_string(spark, d):
    return ranking.context(_ranked(spark, d))


@query
def distinct_first_seen(spark, d):
    rows = table(spark, d, "conversations").select(F.lower("text").substr(1, 3).alias("head"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"), "role")
    return ranking.distinct_first(rows, ["head"], "seq", ["role"])


@query
def empty_context_sentinel(spark, d):
    found = ranking.context(_ranked(spark, d).where("score > 1.0")).withColumnRenamed("context", "answer")
    return ranking.with_sentinel(graphs.questions(spark, d).select("query_id"), found, "answer", experiment.NO_CONTEXT)


# --- vectors ---


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _nearest(spark, d, k, metric="l2"):
    """The searches' query set: every row whose id is divisible by 20."""
    rows = _vectors(spark, d)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors.nearest(asked, rows, k, metric)


@query
def vector_topk(spark, d):
    return _nearest(spark, d, 1)


@query
def vector_topk_multi(spark, d):
    return _nearest(spark, d, 5)


@query
def vector_topk_cosine(spark, d):
    return _nearest(spark, d, 5, "cosine")


@query
def vector_insert_idempotent(spark, d):
    rows = _vectors(spark, d)
    moved = rows.where("id >= 100").withColumn("embedding", F.reverse("embedding"))
    return vectors.insert(rows.where("id < 200"), moved).select("id", F.get("embedding", F.lit(0)).alias("first"))


# --- experiments ---


def _vector_arm(spark, d):
    """Documents with the most distinct keywords of each question, five a question; an equi join on words."""
    asked = graphs.questions(spark, d)
    words = asked.select("query_id", F.explode(F.array_distinct(fn.fallback_keywords(F.col("question")))).alias("word"))
    docs = table(spark, d, "documents").select("doc_id", F.explode(fn.tokens(F.col("text"))).alias("word"))
    shared = docs.join(words, "word").groupBy("query_id", "doc_id").agg(F.count(F.lit(1)).alias("score"))
    best = ranking.top_k(shared.withColumnRenamed("doc_id", "id"), 5, tie="id")
    text = table(spark, d, "documents").select(F.col("doc_id").alias("id"), fn.clean(F.col("text")).alias("body"))
    return best.join(text, "id").select("query_id", "rank", "id", "score", "body")


@query
def vector_arm(spark, d):
    return _vector_arm(spark, d).select("query_id", "rank", "id", "score")


def _results(spark, d):
    asked = graphs.questions(spark, d).withColumn("intent", F.substring("question", 1, 40))
    docs = _vector_arm(spark, d)
    base = ranking.context(docs.withColumnRenamed("body", "triplet"), separator="\n---\n")
    first = docs.where("rank = 1").select("query_id", F.substring_index("body", ". ", 1).alias("answer"))
    base = base.join(first, "query_id")
    edges = ranking.context(_ranked(spark, d)).withColumn("answer", F.substring_index("context", "\n", 3))
    rows = None
    for arch, found, none in (("baseline_vector_rag", base, experiment.NO_DOCUMENTS), ("proposed_graph_rag", edges, experiment.NO_CONTEXT)):
        arm = ranking.with_sentinel(asked, found, "answer", none).select("query_id", F.lit(arch).alias("arch"), "question", "intent", F.coalesce("context", F.lit("")).alias("context"), "answer")
        rows = arm if rows is None else rows.unionByName(arm)
    return experiment.evaluate(rows)


@query
def context_two_ways(spark, d):
    """The documents of a question as the prompt has them and as the judge has them."""
    return ranking.two_contexts(_vector_arm(spark, d), "body")


@query
def experiment_index(spark, d):
    asked = graphs.questions(spark, d)
    done = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    return experiment.numbered_pending(asked, done, "query_id").select("query_id", "run_no")


@query
def results_roundtrip(spark, d):
    """Records written by the sink and read by the source; the even questions and the odd ones in a batch each."""
    path = fresh_path(spark, "results")
    category = F.when(F.col("query_id") % 2 == 0, "even").otherwise("odd")
    made = stored(experiment.records(_results(spark, d).withColumn("category", category)), "records")
    for batch in ("even", "odd"):
        sinks.append_results(made.where(F.col("category") == batch), path)
    read = tables.results(spark, path, required=True)
    names = ("baseline_vector_rag", "proposed_graph_rag")
    parts = [F.col(f"{a}.{c}").alias(f"{a.split('_')[0]}_{c.rpartition('.')[2]}") for a in names for c in ("answer", *(f"scores.{s}" for s in experiment.SCORES))]
    return read.select("id", "category", "question", *parts)


@query
def resume_pending(spark, d):
    asked = graphs.questions(spark, d)
    done = table(spark, d, "labels").select(F.col("doc_id").alias("query_id"))
    return experiment.pending(asked, done, "query_id").select("query_id", "run_no")


@query
def experiment_results(spark, d):
    return _results(spark, d).select("query_id", "arch", "answer", *experiment.METRICS)


@query
def experiment_nested(spark, d):
    out = experiment.nested(_results(spark, d))
    return out.select("query_id", F.col("baseline_vector_rag.answer").alias("baseline_answer"), F.col("proposed_graph_rag.answer").alias("graph_answer"), F.col("proposed_graph_rag.scores.precision").alias("graph_precision"))


@query
def ablation_report(spark, d):
    return experiment.report(_results(spark, d), ["arch"])


@query
def report_console(spark, d):
    return experiment.console_rows(experiment.report(_results(spark, d), ["arch"]))


@query
def report_latex(spark, d):
    return experiment.latex_rows(experiment.report(_results(spark, d), ["arch"]))


def _labelled(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id", "left")


@query
def score_report_labels(spark, d):
    return experiment.report(_labelled(spark, d), ["lang"], ("quality", "toxic"))


@query
def report_by_group(spark, d):
    rows = _labelled(spark, d).rollup("lang", "source").agg(F.avg(F.coalesce("quality", F.lit(0))).alias("quality"), F.count(F.lit(1)).alias("n"))
    return rows


# --- render tables and chat ---


def _lit(spark, d):
    edges, seeds = _g1_seeds(spark, d)
    return edges, graph.k_hop_edges(edges, seeds.where("query_id = 4"), 150)


@query
def highlight_nodes(spark, d):
    return viz.highlight_nodes(_lit(spark, d)[1])


@query
def highlight_edges(spark, d):
    return viz.highlight_edges(_lit(spark, d)[1])


@query
def viz_nodes(spark, d):
    edges, lit = _lit(spark, d)
    shown = graph.sample_edges(edges, 400).withColumns({"source": F.lower("rel"), "page": F.when(F.col("rel") != "HAS_TYPE", F.length("dst").cast("string"))})
    return viz.nodes(shown, viz.highlight_nodes(lit))


@query
def viz_edges(spark, d):
    edges, lit = _lit(spark, d)
    return viz.edges(graph.sample_edges(edges, 400), viz.highlight_edges(lit))


@query
def chat_window(spark, d):
    return chat.window(table(spark, d, "conversations")).select("conv_id", "turn", "role", "text")


@query
def chat_windows_by_turn(spark, d):
    return chat.windows(table(spark, d, "conversations"))


@query
def chat_refusals(spark, d):
    tail = F.when(F.col("conv_id") % 5 == 0, " We Cannot Conclude that.").when(F.col("conv_id") % 7 == 0, "我们无法得出结论。").when(F.col("conv_id") % 11 == 0, "无法得出").otherwise("")
    said = table(spark, d, "conversations").withColumn("text", F.concat("text", tail))
    return chat.refusals(said).select("conv_id", "turn", "role")


def _contexts(spark, d):
    """A context for two of three conversations: what their first turn begins with."""
    first = table(spark, d, "conversations").where("turn = 0 and conv_id % 3 > 0")
    return first.groupBy("conv_id").agg(F.min(F.substring("text", 1, 30)).alias("context"))


@query
def chat_prompt(spark, d):
    made = chat.prompts(table(spark, d, "conversations"), _contexts(spark, d))
    lines = F.array_join(F.transform("prompt", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return made.select("conv_id", F.size("prompt").alias("n"), lines.alias("prompt"))


@query
def chat_settled(spark, d):
    """Answers of which every fifth refuses: neither context nor highlights stay."""
    made = chat.prompts(table(spark, d, "conversations"), _contexts(spark, d))
    answer = F.when(F.col("conv_id") % 5 == 0, "I cannot conclude this.").otherwise(F.concat(F.lit("From: "), "context"))
    answers = chat.settled(made.select("conv_id", "context", answer.alias("answer")))
    lit = chat.highlights(table(spark, d, "conversations").select("conv_id", "role").distinct(), answers)
    return answers.join(lit.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_lit")), "conv_id", "left").select("conv_id", "context", "answer", "refused", F.coalesce("n_lit", F.lit(0)).cast("long").alias("n_lit"))
