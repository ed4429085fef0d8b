"""Models called in batches, and search requests as a stream."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfseek.functions import semistructured as S
from shelfseek.operators import inference as M
from shelfseek.operators.embedding import HOSTED_DIM, Embedder, embed_in_batches
from shelfseek.operators.reports import query_volume
from shelfseek.plans import ann
from shelfseek.registered import views as W
from shelfseek.registered.registry import query
from shelfseek.registered.vector_queries import card, search_sql
from shelfseek.schemas import QUERY_LOG, QUERY_LOG_PRODUCT, SEARCH_REQUEST
from shelfseek.streaming import requests as Z
from shelfseek.workspace import new_path

# --- models -----------------------------------------------------------------------------------------


def _length_embedder() -> Embedder:
    """A stand-in for a hosted model: vectors made from the text's length only."""
    return lambda texts: [[float((len(text) + place) % 7) for place in range(HOSTED_DIM)] for text in texts]


@query("v2_embed_in_batches", f"""SELECT doc_id AS product_id, {HOSTED_DIM}::BIGINT AS dim, (length(text) % 7)::DOUBLE AS first,
  (SELECT sum((length(text) + x) % 7) FROM range({HOSTED_DIM}) t(x))::DOUBLE AS total FROM documents""")
def v2(spark, sf_dir):
    embedded = embed_in_batches(W.documents(spark, sf_dir), "product_id", "text", _length_embedder)
    total = F.aggregate("embedding", F.lit(0.0), lambda t, x: t + x.cast("double"))
    return embedded.select(
        "product_id", F.size("embedding").cast("bigint").alias("dim"),
        F.get("embedding", F.lit(0)).cast("double").alias("first"), total.alias("total"),
    )


def _prompts(spark, sf_dir) -> DataFrame:
    """Every user turn as a prompt, with the system text of its conversation."""
    turns = W.table(spark, sf_dir, "conversations")
    system = turns.where("role = 'system'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("system_instruction"))
    asked = turns.where("role = 'user'").join(system, "conv_id", "left")
    return asked.select(
        (F.col("conv_id") * 100000 + F.col("turn")).alias("prompt_id"), F.col("text").alias("prompt"),
        "system_instruction", F.length("text").alias("n"),
    )


_PROMPTS = """prompts AS (
  SELECT conv_id * 100000 + turn AS prompt_id, text AS prompt, length(text) AS n, s AS system_instruction
  FROM conversations LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS s FROM conversations WHERE role = 'system' GROUP BY 1) USING (conv_id)
  WHERE role = 'user')"""


def _counting_model() -> M.Model:
    def answer(rows: list[dict]) -> list[str]:
        return [f"{len(row['prompt'])}/{len(row['system_instruction'] or '')}" for row in rows]

    return answer


@query("l1_batch_prompt", f"""WITH {_PROMPTS}
SELECT prompt_id, n || '/' || coalesce(length(system_instruction), 0) AS response, 'ok' AS status FROM prompts""")
def l1(spark, sf_dir):
    return M.run_prompts(_prompts(spark, sf_dir), _counting_model).select("prompt_id", "response", "status")


@query("l1_calls_in_flight", f"""WITH {_PROMPTS}
SELECT prompt_id, n || '/' || coalesce(length(system_instruction), 0) AS response, 'ok' AS status FROM prompts""")
def l1_in_flight(spark, sf_dir):
    """The same with sixteen groups of five asked at once in every task."""
    answers = M.run_prompts(_prompts(spark, sf_dir), _counting_model, group_size=5, in_flight=16)
    return answers.select("prompt_id", "response", "status")


def _failing_model() -> M.Model:
    """Refuses a lone prompt n mod 7 times with 429 first, and any with 400 where n is a multiple of 11.

    A group with a refused prompt fails as a whole, or answers some of its prompts with an exception.
    """
    seen: Counter = Counter()

    def refusal(row: dict) -> Exception | None:
        if row["n"] % 13 == 0:
            return TimeoutError("too late")
        return M.ModelError(400) if row["n"] % 11 == 0 else M.ModelError(429) if row["n"] % 7 else None

    def answer(rows: list[dict]) -> list:
        if len(rows) > 1:
            if rows[0]["n"] % 2:
                raise M.ModelError(400)
            return [refusal(row) or "done" for row in rows]
        (row,) = rows
        if row["n"] % 13 == 0 or row["n"] % 11 == 0:
            raise refusal(row)
        seen[row["prompt_id"]] += 1
        if seen[row["prompt_id"]] <= row["n"] % 7:
            raise M.ModelError(429)
        return ["done"]

    return answer


@query("l2_inference_retry_status", f"""WITH {_PROMPTS}
SELECT prompt_id, CASE WHEN n % 13 = 0 THEN 'Error: TimeoutError' WHEN n % 11 = 0 THEN 'Error: failed (status 400)'
    WHEN n % 7 >= 5 THEN 'Error: failed (status 429)' ELSE 'done' END AS response,
  CASE WHEN n % 13 = 0 OR n % 11 = 0 OR n % 7 >= 5 THEN 'error' ELSE 'ok' END AS status,
  CASE WHEN n % 13 = 0 OR n % 11 = 0 THEN 1 WHEN n % 7 >= 5 THEN 5 ELSE n % 7 + 1 END::BIGINT AS attempts,
  (n % 13 = 0 OR n % 11 = 0 OR n % 7 >= 5) AS again FROM prompts""")
def l2(spark, sf_dir):
    """Mixed failures in groups of thirty; the answers are written once and then used twice."""
    prompts = _prompts(spark, sf_dir)
    path = new_path(spark, "answers")
    M.run_prompts(prompts, _failing_model, pause=_no_pause).write.parquet(path)
    answers = spark.read.parquet(path)
    again = M.unanswered(prompts, answers).select("prompt_id", F.lit(True).alias("again"))
    return answers.join(again, "prompt_id", "left").select(
        "prompt_id", "response", "status", F.col("attempts").cast("bigint").alias("attempts"),
        F.coalesce("again", F.lit(False)).alias("again"),
    )


def _no_pause(seconds: float) -> None:
    del seconds


def _responses(spark, sf_dir) -> DataFrame:
    """Every turn as a model response in JSON: with sources, without a candidate, and cut off."""
    turns = W.table(spark, sf_dir, "conversations")
    web = lambda uri, title: F.struct(F.struct(uri.alias("uri"), title.alias("title")).alias("web"))
    link = F.concat(F.lit("http://source/"), F.col("conv_id").cast("string"))
    sources = F.array(web(link, F.col("role")), web(link, F.lit("")), web(F.lit(None).cast("string"), F.col("role")))
    body = F.struct(
        F.array(
            F.struct(
                F.struct(F.array(F.struct(F.col("text"))).alias("parts")).alias("content"),
                F.struct(sources.alias("groundingAttributions")).alias("groundingMetadata"),
            )
        ).alias("candidates")
    )
    shapes = [F.to_json(body), F.lit('{"candidates": []}'), F.lit('{"candidates": [{"content"')]
    return W.variants(turns, "response", shapes)


@query("l3_parse_responses", """SELECT conv_id, turn, v AS variant, CASE WHEN v = 0 THEN text ELSE '' END AS answer,
  CASE WHEN v = 0 THEN 'http://source/' || conv_id END AS uri, CASE WHEN v = 0 THEN role END AS title
FROM conversations, range(3) t(v)""")
def l3(spark, sf_dir):
    read = _responses(spark, sf_dir).select(
        "conv_id", "turn", F.col("variant").cast("bigint").alias("variant"), S.response_text(F.col("response")).alias("answer"),
        F.explode_outer(S.response_sources(F.col("response"))).alias("source"),
    )
    return read.select("conv_id", "turn", "variant", "answer", "source.uri", "source.title")


@query("l4_effective_config", f"""WITH {_PROMPTS}
SELECT prompt_id, CASE WHEN n > 200 THEN n / 1000.0::DOUBLE ELSE 0.5 END AS temperature,
  CASE WHEN n > 100 THEN n ELSE 2048 END::BIGINT AS max_output_tokens, 1.0::DOUBLE AS top_p, 1.0::DOUBLE AS top_k FROM prompts""")
def l4(spark, sf_dir):
    prompts = _prompts(spark, sf_dir).withColumns(
        {
            "temperature": F.when(F.col("n") > 200, F.col("n") / 1000),
            "max_output_tokens": F.when(F.col("n") > 100, F.col("n")),
            "top_p": F.lit(None).cast("double"),
        }
    )
    return M.effective_settings(prompts, {"temperature": 0.5}).select(
        "prompt_id", "temperature", F.col("max_output_tokens").cast("bigint").alias("max_output_tokens"), "top_p", "top_k"
    )


# --- streams ----------------------------------------------------------------------------------------

Started = Callable[..., Z.StreamingQuery]


def _run(spark, sf_dir, start: Started) -> str:
    """Feed every search text to a stream as request files and wait for the end; returns the output path."""
    folder, out = new_path(spark, "requests"), new_path(spark, "stream")
    asked = W.requests(spark, sf_dir, 100).select(*[F.col(f.name).cast(f.dataType) for f in SEARCH_REQUEST.fields])
    asked.repartition(4, "query_id").write.parquet(folder)
    stream = Z.request_stream(spark, folder, SEARCH_REQUEST, files_per_batch=2)
    running = start(
        stream, W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM, out, new_path(spark, "progress")
    )
    running.awaitTermination()
    return out


@query("s1_stream_search", f"""WITH {search_sql(100)}
SELECT query_id, rank, product_id, title, category, store, price, average_rating, rating_number,
       round(distance, 6) AS distance FROM found""")
def s1(spark, sf_dir):
    return card(spark.read.parquet(_run(spark, sf_dir, Z.stream_search)))


@query("s1_stream_search_cells", f"""WITH {search_sql(100)}
SELECT query_id, rank, product_id, title, category, store, price, average_rating, rating_number,
       round(distance, 6) AS distance FROM found""")
def s1_cells(spark, sf_dir):
    """The same from an index of cells, opened again; looking into all of them is exact."""
    vectors = W.vectors(spark, sf_dir)
    centres = ann.sampled_centres(vectors, W.DIM)
    index = ann.open_cells(spark, ann.write_cells(vectors, centres, W.DIM).path)

    def start(stream, _, *rest):
        return Z.stream_search(stream, index, *rest, probes=len(centres))

    return card(spark.read.parquet(_run(spark, sf_dir, start)))


@query("s2_stream_query_log", f"""WITH {search_sql(100)}
SELECT text AS query_text, 1::BIGINT AS user_id, product_id FROM benchmark LEFT JOIN found ON query_id = item_id""")
def s2(spark, sf_dir):
    return _logged(spark, _run(spark, sf_dir, Z.stream_query_log))


@query("s2_repeated_requests", f"""WITH {search_sql(100)}
SELECT text AS query_text, 1::BIGINT AS user_id, product_id FROM benchmark LEFT JOIN found ON query_id = item_id""")
def s2_repeated(spark, sf_dir):
    """Every request comes twice within a run and again after a restart; each is logged once."""
    folder, out, progress = (new_path(spark, name) for name in ("requests", "stream", "progress"))
    asked = W.requests(spark, sf_dir, 100).select(*[F.col(f.name).cast(f.dataType) for f in SEARCH_REQUEST.fields])
    for _ in range(2):
        for _ in range(2):
            asked.coalesce(1).write.mode("append").parquet(folder)
        stream = Z.request_stream(spark, folder, SEARCH_REQUEST, files_per_batch=1)
        running = Z.stream_query_log(stream, W.vectors(spark, sf_dir), W.products(spark, sf_dir), W.DIM, out, progress)
        running.awaitTermination()
    return _logged(spark, out)


def _logged(spark, out: str) -> DataFrame:
    entries = Z.read_batches(spark, f"{out}/query_log", QUERY_LOG)
    bridge = Z.read_batches(spark, f"{out}/query_log_product", QUERY_LOG_PRODUCT)
    return entries.join(bridge, "query_id", "left").select(
        "query_text", F.col("user_id").cast("bigint").alias("user_id"), "product_id"
    )


_DAYS = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS query_text, count(*) AS n_searches FROM events"


@query("s3_query_volume_windows", f"{_DAYS} GROUP BY ALL")
def s3(spark, sf_dir):
    log = W.table(spark, sf_dir, "events").select(F.col("ts"), F.col("event_type").alias("query_text"))
    counted = query_volume(log, F.col("ts"), "1 day")
    return counted.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "query_text", "n_searches")


@query("s3_query_volume_stream", f"{_DAYS} GROUP BY ALL")
def s3_stream(spark, sf_dir):
    """The same counts from a stream, open days included."""
    events = W.table(spark, sf_dir, "events")
    stream = (
        spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
        .select(F.col("ts").alias("timestamp"), F.col("event_type").alias("query_text"))
    )
    out = new_path(spark, "volume")
    Z.stream_query_volume(stream, out, new_path(spark, "progress")).awaitTermination()
    return Z.read_query_volume(spark, out).select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "query_text", "n_searches"
    )
