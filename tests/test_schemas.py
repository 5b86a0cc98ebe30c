"""Plan outputs conform to the declared table schemas."""

from pyspark.sql import functions as F

from filingflow import schemas
from filingflow.operators import model
from filingflow.plans import proxy_ingest, recommendation, vote_extraction

WORDS = " ".join(f"word{i}." if i % 9 == 8 else f"word{i}" for i in range(1200))


def names_types(schema):
    return [(f.name, f.dataType.simpleString()) for f in schema.fields]


def test_votes_and_questions_conform(spark):
    target = schemas.empty(spark, schemas.VOTES)
    parsed = model.parse_output(spark.createDataFrame(
        [("j", "0000000001", '{"ticker": "T", "meeting_date": "2022-05-06", "voting_results": '
          '[{"questionId": "1", "resolution": "r", "for": 3, "against": 1, "abstentions": 0}]}', None)],
        "job_id string, cik string, model_output string, model_error string"), model.TALLY_SCHEMA)
    tallies, _ = vote_extraction.tally_rows(parsed)
    merged, _ = vote_extraction.store_votes(target, tallies)
    assert names_types(schemas.conform(merged, schemas.VOTES).schema) == names_types(schemas.VOTES)
    assert schemas.conform(merged, schemas.VOTES).count() == 1

    docs = spark.createDataFrame([(7, WORDS)], "filing_id long, text string")
    qs, _ = proxy_ingest.questions_from_documents(docs, model.stub_question_model(min_words=9))
    q = schemas.conform(qs, schemas.PROXY_QUESTIONS)
    assert names_types(q.schema) == names_types(schemas.PROXY_QUESTIONS)
    n = q.count()
    assert n > 100
    stored = proxy_ingest.store_questions(schemas.empty(spark, schemas.PROXY_QUESTIONS), q)
    assert stored.count() == n


def test_chunks_and_results_conform(spark):
    docs = spark.createDataFrame([(7, WORDS)], "filing_id long, text string")
    ch = proxy_ingest.embed_chunks(proxy_ingest.filing_chunks(docs))
    c = schemas.conform(ch, schemas.PROXY_CHUNKS)
    assert c.count() == 2 and c.where(F.size("embedding") == model.EMBED_DIM).count() == 2
    res = spark.createDataFrame([(7, "1", "For", "r", "c", 0.5, "facts", "none")],
                                "filing_id long, question_id string, voting_recommendation string, "
                                "rationale string, citation string, confidence double, key_facts string, "
                                "policy_breaches string") \
        .withColumn("updated_at", F.current_timestamp())
    out = recommendation.store_results(schemas.empty(spark, schemas.RECOMMENDATIONS_TABLE), res)
    assert names_types(schemas.conform(out, schemas.RECOMMENDATIONS_TABLE).schema) == \
        names_types(schemas.RECOMMENDATIONS_TABLE)
