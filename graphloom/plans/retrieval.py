"""End-to-end plans over a user's own tables: build the collection and the graph, answer, run and resume experiments.

Each is one lazy plan over all questions; models come in through ``Backends`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as fn
from graphloom.operators import chat, chunking, experiment, graph, ranking, triples, vectors
from graphloom.operators.backends import Backends
from graphloom.sources import tables
from graphloom.storage import stored

BASELINE, PROPOSED = "baseline_vector_rag", "proposed_graph_rag"


def build_collection(pages: DataFrame, backends: Backends | None = None, size: int = 1200, overlap: int = 250) -> DataFrame:
    """Vector records (id, document, embedding) of pages(doc_id, page_idx, text): whole documents, cleaned and chunked."""
    docs = tables.document_text(pages, "doc_id", "page_idx", F.col("text"))
    chunks = chunking.chunk_recursive(docs, "doc_id", fn.clean(F.col("text")), size, overlap)
    numbered = chunking.chunk_numbers(chunks, "doc_id", bucket=F.substring(F.col("doc_id").cast("string"), 1, 64))
    return (backends or Backends()).with_embedding(numbered.select(F.col("chunk_id").alias("id"), F.col("chunk").alias("document")), "document")


def build_graph(pages: DataFrame, backends: Backends | None = None, size: int = 1000, overlap: int = 150, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges, quarantine) of the pages in range: chunk, extract, validate, normalise, upsert in the order of document, page,
    chunk and item."""
    rows = tables.page_range(pages).select(F.struct("doc_id", "page_idx").alias("place"), "text")
    chunks = chunking.chunk_recursive(rows, "place", F.col("text"), size, overlap, chunking.GRAPH_SEPARATORS)
    chunks = chunks.select(F.struct("place", "chunk_pos").alias("place"), "chunk")
    if backends is None or backends.extract is None:
        found = triples.extract_sentences(chunks, "place", F.col("chunk"))
    else:
        found = triples.parse_replies(backends.with_triples(chunks.withColumnRenamed("chunk", "text")), "place", F.col("reply"))
    edges, bad = triples.normalise(found)
    page = F.col("place.place")
    writes = edges.select("src", "rel", "dst", "description", page["doc_id"].alias("source"), fn.page_label(page["page_idx"]).alias("page"), F.struct("place", "item").alias("seq"))
    new = graph.collapse(writes, F.col("seq")).drop("seq")
    return (new if existing is None else graph.merge_edges(existing, new)), bad


def graph_evidence(questions: DataFrame, edges: DataFrame, backends: Backends | None = None, k: int = 12, limit: int = 10, engine: bool = True) -> DataFrame:
    """(query_id, rank, triplet, score, src, rel, dst): the best triplets for questions(query_id, question) and the edges they
    are rendered from (in the direction of the text), from shortest paths between the first two keywords' nodes and from
    all keywords' neighbours. ``engine``: keywords by the engine's rule, else by the dashboard's."""
    backends = backends or Backends()
    words = stored(graph.keyword_rows(backends.with_keywords(questions, engine=engine), "query_id", F.col("keywords")), "keywords")
    plain = stored(edges.select("src", "rel", "dst"), "edges")
    found = graph.seeds(graph.vertices(plain), words)
    held = graph.candidates(graph.shortest_paths(plain, found), graph.neighbours(plain, found, limit))
    rows = held.select("query_id", fn.render(F.col("src"), F.col("rel"), F.col("dst")).alias("triplet"), "src", "rel", "dst")
    pairs = ranking.distinct_texts(rows, ("src", "rel", "dst"))
    scored = backends.with_score(pairs.join(questions.select("query_id", "question"), "query_id"))
    return ranking.top_k(scored, k).select("query_id", "rank", "triplet", "score", "src", "rel", "dst")


def graph_contexts(questions: DataFrame, edges: DataFrame, backends: Backends | None = None, k: int = 12, limit: int = 10, engine: bool = True) -> DataFrame:
    """(query_id, context): the texts of ``graph_evidence``, a line each."""
    return ranking.context(graph_evidence(questions, edges, backends, k, limit, engine))


def chat_turn(messages: DataFrame, questions: DataFrame, edges: DataFrame, backends: Backends | None = None, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """One turn of all conversations: messages(conv_id, turn, role, text) with the new ones, and questions(query_id = conv_id,
    question). (answers, highlights): answers(conv_id, context, prompt, answer, refused); highlights(conv_id, src, rel,
    dst) are the evidence's edges; a refusal has neither context nor highlights."""
    backends = backends or Backends()
    evidence = stored(graph_evidence(questions, edges, backends, k, engine=False), "evidence")
    contexts = ranking.context(evidence).withColumnRenamed("query_id", "conv_id")
    answers = stored(chat.settled(backends.with_chat_answer(chat.prompts(messages, contexts))), "answers")
    lit = evidence.select(F.col("query_id").alias("conv_id"), "src", "rel", "dst").distinct()
    return answers, chat.highlights(lit, answers)


def vector_contexts(questions: DataFrame, collection: DataFrame, backends: Backends | None = None, k: int = 5) -> DataFrame:
    """(query_id, context, judged): the k nearest chunks of collection(id, document, embedding); the prompt's context has rules
    between them, the judge's has line ends."""
    asked = (backends or Backends()).with_embedding(questions.select("query_id", "question"), "question").withColumnRenamed("embedding", "query")
    near = vectors.nearest(asked, collection.select("id", "embedding"), k)
    return ranking.two_contexts(near.join(collection.select("id", "document"), "id"), "document")


def answers(questions: DataFrame, contexts: DataFrame, arch: str, sentinel: str, default: Column, backends: Backends | None = None) -> DataFrame:
    """(query_id, arch, question, intent, context, answer, and category if known); a question without context gets the
    sentinel, no model. The context is the judge's: ``judged`` of the contexts, if they have it."""
    rows = (backends or Backends()).with_answer(questions.join(contexts, "query_id"), default)
    rows = rows.select("query_id", F.col("judged" if "judged" in contexts.columns else "context").alias("context"), "answer")
    out = ranking.with_sentinel(questions, rows, "answer", sentinel)
    return out.select("query_id", F.lit(arch).alias("arch"), "question", "intent", F.coalesce("context", F.lit("")).alias("context"), "answer", *(c for c in ("category",) if c in questions.columns))


def run_experiment(questions: DataFrame, done: DataFrame, collection: DataFrame, edges: DataFrame, backends: Backends | None = None) -> DataFrame:
    """Scored answers of both arms, for the questions(query_id, question, intent, and category if known) that ``done`` lacks:
    a table with query_id, or records as ``tables.results`` reads them (id)."""
    if "query_id" not in done.columns:
        done = done.select(F.col("id").cast(questions.schema["query_id"].dataType).alias("query_id"))
    todo = experiment.pending(questions, done, "query_id").drop("run_no")
    base = answers(todo, vector_contexts(todo, collection, backends), BASELINE, experiment.NO_DOCUMENTS, F.substring_index("context", "\n---\n", 1), backends)
    ours = answers(todo, graph_contexts(todo, edges, backends), PROPOSED, experiment.NO_CONTEXT, F.substring_index("context", "\n", 3), backends)
    return (backends or Backends()).with_judgement(base.unionByName(ours))
