"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import chat, common, decontaminate, exact_dedup, language, licenses, packing, pii, quality, simhash, spelling, suffix_dedup, token_file, vector_codes


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "tokens")
    token_file.write_tokens(common.documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_file.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return language.identify(docs, language.train(docs))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(common.documents(spark, sf_dir)).drop("kept")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    found = pii.find_pii(docs, pii.train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in pii.KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{said}'), (-7L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    read = chat.read_back(chat.render(chat.reconstruct(chat.events_of(rows.unionByName(extra)))))
    masked = F.array_join("masked", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"), F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(common.documents(spark, sf_dir))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.documents(spark, sf_dir))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.train_and_score(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return coded.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(common.documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_token_file, op2_license_scan, op3_decontaminate, op4_language, op5_suffix_dedup, op6_pii, op7_chat_format, op8_simhash_near_dedup, op9_packing, op10_exact_dedup, op11_quality, op12_vector_codes, op13_spelling_variants)}

_LOWER = f"translate(coalesce(text, ''), '{common.UPPER}', '{common.LOWER}')"
_ESCAPED = "regexp_replace(replace(coalesce({0}, ''), chr(92), chr(92) || chr(92)), '<(\\||s>|/s>|<SYS>>|</SYS>>)|\\[(INST\\]|/INST\\])', '##\\0', 'g')"



def _vector_codes_sql() -> str:
    """Each round as two tables: the nearest entries, then the new ones. Whole numbers in doubles, so exact."""
    dot = "list_inner_product"
    steps = [
        f"""WITH kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor({vector_codes.SCALE} * x::DOUBLE)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"part AS MATERIALIZED (SELECT vec_id, label, p, v[p * len(v) // {vector_codes.PARTS} + 1:(p + 1) * len(v) // {vector_codes.PARTS}] AS x FROM kept, range({vector_codes.PARTS}) AS r(p))",
        f"book0 AS MATERIALIZED (SELECT p, e, x AS c FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM part) WHERE e < {vector_codes.ENTRIES})",
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""near{k} AS MATERIALIZED (SELECT vec_id, label, p, x, min((d, e)) AS best FROM (
            SELECT a.*, e, {dot}(x, x) - 2 * {dot}(x, c) + {dot}(c, c) AS d FROM part a JOIN book{k} USING (p)) GROUP BY ALL)""")
        if k < vector_codes.ROUNDS:
            steps.append(f"""book{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.c, b.c) AS c FROM book{k} b LEFT JOIN (
                SELECT p, e, list(m ORDER BY i) AS c FROM (SELECT p, best[2] AS e, i, floor(sum(x[i]) / count(*)) AS m FROM near{k}, unnest(range(1, len(x) + 1)) AS u(i) GROUP BY ALL) GROUP BY p, e) n USING (p, e))""")
    last = vector_codes.ROUNDS
    steps.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM near{last} GROUP BY vec_id, label)")
    return ", ".join(steps) + f"""
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
            (SELECT sha256(string_agg(c[i]::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) FROM book{last}, unnest(range(1, len(c) + 1)) AS u(i)) AS codebooks_sha256
        FROM coded"""


#: The crc32 of a run behind its doc_id, bit by bit; near words by levenshtein, which counts bytes, over letters that have one each.
_SPELLING_SQL = f"""
    WITH RECURSIVE run AS MATERIALIZED (
        SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]+')), '{common.UPPER}', '{common.LOWER}') AS run FROM documents)
        WHERE length(run) >= {spelling.LEAST_LENGTH} GROUP BY ALL),
    bytes AS (
        SELECT *, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS b FROM run),
    bits AS (SELECT doc_id, run, n, flatten(list_transform(b, lambda x: list_transform([0, 1, 2, 3, 4, 5, 6, 7], lambda k: ((x >> k) & 1)::BIGINT))) AS b FROM bytes),
    hash AS MATERIALIZED (SELECT run, n, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, k: xor(c >> 1, (xor(c, k) & 1) * 3988292384)), 4294967295) AS h FROM bits),
    word AS MATERIALIZED (
        SELECT word, sum(n)::BIGINT AS n FROM (
            SELECT n, CASE WHEN h % {spelling.SPOILED} = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hash)
        WHERE length(word) >= {spelling.LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
    one AS MATERIALIZED (SELECT *, length(word) AS size, translate(word, '{"".join(map(chr, range(0xC0, 0x100)))}', '{common.UPPER}{"".join(map(str, range(10)))}!#$%&()*+,-./:;<=>?@[]^_{{|}}~') AS w FROM word),
    near AS MATERIALIZED (
        SELECT a.word, b.word AS near, b.n AS near_n FROM one a JOIN one b ON b.size BETWEEN a.size - 1 AND a.size + 1 AND a.w <> b.w
        WHERE (left(a.w, 3) = left(b.w, 3) OR right(a.w, 3) = right(b.w, 3)) AND levenshtein(a.w, b.w) = 1),
    best AS (SELECT word, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, near)) AS near FROM near GROUP BY word),
    form AS MATERIALIZED (
        SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {spelling.FACTOR} * n THEN near END AS form, CASE WHEN most >= {spelling.FACTOR} * n THEN most END AS form_n FROM word LEFT JOIN best USING (word)),
    step AS (SELECT word, word AS root, form AS next FROM form UNION ALL SELECT s.word, f.word, f.form FROM step s JOIN form f ON s.next = f.word)
    SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n FROM form f JOIN step s ON s.word = f.word AND s.next IS NULL"""


ORACLES = {
    "op13_spelling_variants": _SPELLING_SQL,
    "op12_vector_codes": _vector_codes_sql(),
    "op7_chat_format": f"""
        WITH rows AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
            sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum({len(chat.TURN + chat.TEXT + chat.END)} + length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')})
                - (length({_ESCAPED.format('role')}) - length(replace({_ESCAPED.format('role')}, '##', '#')))
                - (length({_ESCAPED.format('text')}) - length(replace({_ESCAPED.format('text')}, '##', '#'))))::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op10_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
            row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
        FROM n""",
}
