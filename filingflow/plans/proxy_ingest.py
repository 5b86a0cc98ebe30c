"""E1: proxy statements -> text -> chunks -> embeddings -> questions.

Set-at-a-time over all companies and years: a per-company loop becomes
the key columns ``(cik, accession_number)`` / ``filing_id``.

Stage boundaries worth persisting (``write`` them at scale): the chunk table
(input of the embedder) and the embedded chunks (the expensive model output).
Everything before the embedder is one scan-side plan with a single anti join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingflow.functions import forms, keys, text
from filingflow.operators import chunking, concat, merge, model, quality, retrieval
from filingflow.session import materialize
from filingflow.sources import directory as dir_src

# The five retrieval query phrases, minimum filing length, depth.
MULTI_QUERIES = (
    "proxy proposals table",
    "list of proposals",
    "shareholder proposals",
    "director nominees",
    "proxy voting items",
)
MIN_FILING_WORDS = 500
RAG_TOP_K = retrieval.RAG_TOP_K

QUESTION_PROMPT = ("Extract every proxy voting question from the passages of {company} "
                   "(filing {filing}) below as JSON.\n\n{context}")


def select_proxy_filings(index_rows: DataFrame, year: int | None = None) -> DataFrame:
    """FLT-3 (+ FLT-1 when ``year``): DEF 14A / DEFR14A rows of a normalised index
    ``(cik, accessionNumber, filing_date, form, primaryDocument)``; adds keys.
    A filing listed on several index pages is kept once: the row with the latest
    filing date, then the greatest form and document name."""
    sel = index_rows.where(forms.is_proxy_statement("form"))
    if year is not None:
        sel = sel.where(keys.year_range("filing_date", year))
    cik = keys.pad_cik("cik")
    rows = sel.select(
        cik.alias("cik"), F.col("accessionNumber").alias("accession_number"),
        F.col("primaryDocument").alias("primary_document"), "filing_date", "form",
        keys.proxy_id(cik, F.col("accessionNumber")).alias("proxy_id"),
        keys.archive_url(cik, F.col("accessionNumber"), F.col("primaryDocument")).alias("url"))
    cols = ["cik", "accession_number", "primary_document", "filing_date", "form", "url"]
    last = F.max_by(F.struct(*cols), F.struct("filing_date", "form", "primary_document"))
    return rows.groupBy("proxy_id").agg(last.alias("_r")).select(*[f"_r.{c}" for c in cols[:-1]], "proxy_id", "_r.url")


def new_filings(selected: DataFrame, stored: DataFrame, redo: DataFrame | None = None) -> DataFrame:
    """JN-2 / ST-6: skip filings already stored (``proxy_id``), unless in ``redo``."""
    return merge.skip_done(selected, stored.select("proxy_id"), ["proxy_id"], redo)


def tag_filing_texts(filings: DataFrame, documents: DataFrame, key: str = "url",
                     html_col: str = "html", min_words: int = MIN_FILING_WORDS) -> DataFrame:
    """JN-7 + SC-6 + FLT-6: filings with clean text and a ``reject_reason``
    (missing document, too short; null = keep)."""
    j = filings.join(documents.select(key, html_col), key, "left")
    t = text.add_clean_text(j, html_col, "text").drop(html_col)
    return quality.validate(t, [("document missing", F.col("text").isNotNull()),
                                ("too short", text.has_min_words("text", min_words))])


def filing_texts(filings: DataFrame, documents: DataFrame, key: str = "url",
                 html_col: str = "html", min_words: int = MIN_FILING_WORDS) -> tuple[DataFrame, DataFrame]:
    """``(kept, rejects)`` of ``tag_filing_texts``; the rest continue (Q15).
    Persist the tagged rows first when both sides are consumed."""
    return quality.split(tag_filing_texts(filings, documents, key, html_col, min_words))


def filing_records(texts: DataFrame, companies: DataFrame | None = None) -> DataFrame:
    """PRJ-5 + JN-1 + SNK-5 key: deterministic surrogate ``filing_id``."""
    out = texts.withColumn("filing_id", F.xxhash64("proxy_id"))
    if companies is not None:
        out = dir_src.with_company(out, companies, "cik")
    return out


def filing_chunks(texts: DataFrame, id_col: str = "filing_id") -> DataFrame:
    """WN-5 / WN-6: ``(filing_id, chunk_index, n_tokens, chunk_text)``."""
    return chunking.chunk_text(texts, "text", [id_col])


def embed_chunks(chunks: DataFrame, embedder=None, dedupe: bool = False) -> DataFrame:
    """UD-4: adds ``embedding array<float>``.

    ``dedupe`` embeds each distinct chunk text once (two extra shuffles of the
    chunk text).  Worth it for a remote, per-call-priced embedder; with a
    cheap local one it is slower (measured at sf0.1: 6% duplicate chunks,
    ~2.5 s plain vs ~3-4.7 s deduplicated).
    """
    if dedupe:
        return model.embed_texts_once(chunks, "chunk_text", "embedding", embedder)
    return chunks.withColumn("embedding", model.embed_column("chunk_text", embedder))


def query_vectors(embedder=None, phrases=MULTI_QUERIES) -> list[list[float]]:
    """SRC-11: the fixed query phrases embedded once (five short strings)."""
    import pandas as pd
    fn = embedder or model.hashing_embedder()
    return [list(v) for v in fn(pd.Series(list(phrases)))]


def retrieval_context(chunks: DataFrame, queries, id_col: str = "filing_id",
                      k: int = RAG_TOP_K, merge_mode: str = "best_score") -> DataFrame:
    """JN-5a + WN-3/WN-4 + AG-2: ``(filing_id, context, n_parts)``.

    The chunk text rides along through the ranking: the partial top-k before
    the shuffle means only k rows per filing and partition are moved.
    """
    scored = retrieval.score_all(chunks.select(id_col, "chunk_index", "chunk_text", "embedding"),
                                 queries, id_col).drop("embedding")
    if merge_mode == "best_score":
        top = retrieval.merge_best_score(scored, id_col, "chunk_index", k)
    else:
        per_q = retrieval.top_k_per_query(scored.drop("chunk_text"), id_col, "chunk_index", k)
        ranked = retrieval.merge_first_seen(per_q, id_col, "chunk_index", k)
        top = ranked.join(chunks.select(id_col, "chunk_index", "chunk_text"), [id_col, "chunk_index"])
    return concat.context_concat(top, [id_col], ["merged_rank"], "chunk_text")


def extract_questions(contexts: DataFrame, fn: model.ModelFn, id_col: str = "filing_id",
                      company_col: str | None = None, max_concurrency: int | None = None,
                      store_output: bool = True) -> tuple[DataFrame, DataFrame]:
    """SC-19 + UD-2 + UD-7 + SC-17: ``(questions, rejects)``.

    With ``store_output`` the raw model output is written once to the
    checkpoint folder: questions and rejects come from the same calls.
    """
    company = F.col(company_col) if company_col else F.lit("the company")
    prompt = F.format_string(QUESTION_PROMPT.replace("{company}", "%1$s").replace("{filing}", "%2$s")
                             .replace("{context}", "%3$s"), company, F.col(id_col).cast("string"),
                             F.col("context"))
    src = contexts.withColumn("prompt", prompt)
    # the model sees the prompt only (it embeds the context)
    out = model.apply_model(src, fn, ["prompt"], [id_col], max_concurrency=max_concurrency)
    if store_output:
        out = materialize(out, "question-model-output")
    parsed = model.parse_output(out, model.QUESTION_SCHEMA)
    failed = parsed.where(~model.parse_ok()).select(
        id_col, F.coalesce("model_error", F.lit("malformed model output")).alias("reject_reason"))
    qs = parsed.where(model.parse_ok()).select(id_col, F.inline("parsed.proxy_questions"))
    shaped = qs.select(
        id_col, "question_id", "question_text",
        F.col("board_vote_recommendation").alias("board_vote_recommend"), "question_type",
        F.col("is_shareholder_proposal").try_cast("boolean").alias("is_shareholder"))
    tagged = quality.validate(shaped, [
        ("missing question_id", quality.present("question_id")),
        ("bad board vote", quality.one_of("board_vote_recommend", model.BOARD_VOTES)),
        ("bad question type", quality.one_of("question_type", model.QUESTION_TYPES)),
        ("bad shareholder flag", F.col("is_shareholder").isNotNull()),
    ])
    good, bad = quality.split(tagged)
    good = good.withColumn("status", F.lit("NEW")) \
        .withColumn("question_embedding", F.lit(None).cast("array<float>"))
    return good, failed.unionByName(bad.select(id_col, "reject_reason"))


QUESTION_RULES = {"question_text": merge.REPLACE, "board_vote_recommend": merge.REPLACE,
                  "question_type": merge.REPLACE, "is_shareholder": merge.REPLACE,
                  "question_embedding": merge.KEEP_IF_NULL, "status": merge.REPLACE}


def store_questions(target: DataFrame, batch: DataFrame, order_col: str | None = None,
                    id_col: str = "filing_id") -> DataFrame:
    """SNK-7: upsert keyed by (filing_id, question_id); a null embedding keeps
    the stored one (Q7: the key includes the filing)."""
    return merge.upsert(target, batch, [id_col, "question_id"], QUESTION_RULES, order_col)


def questions_from_documents(documents: DataFrame, fn: model.ModelFn | None = None,
                             embedder=None, min_words: int = MIN_FILING_WORDS,
                             k: int = RAG_TOP_K) -> tuple[DataFrame, DataFrame]:
    """Whole E1 tail for plain-text filings ``(filing_id, text)``."""
    kept = documents.where(text.has_min_words("text", min_words))
    chunks = filing_chunks(kept)
    emb = embed_chunks(chunks, embedder)
    ctx = retrieval_context(emb, query_vectors(embedder), k=k)
    return extract_questions(ctx, fn or model.stub_question_model())
