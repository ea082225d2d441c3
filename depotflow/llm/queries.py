"""Registered queries of the corpus operators, and SQL for those that SQL can state."""

from pyspark.sql import functions as F

from ..session import fresh_path
from .codes import compress_vectors
from .common import table
from .embeddings import near_vectors
from .hard_negatives import mine_hard_negatives
from .lattice import decode_documents, encode_documents
from .line_dedup import dedup_lines
from .lm import score_documents
from .packing import pack_documents
from .quality_model import score_quality
from .quality_rules import judge_documents
from .secrets import scan_secrets
from .simhash import near_duplicates
from .url_filter import judge_urls
from .warc import read_archives, resolve_revisits, write_archives

QUERIES, ORACLES = {}, {}


def query(build):
    QUERIES[build.__name__] = build
    return build


@query
def op1_secret_scan(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def tokenizer_spec(name="byte_bpe_50k.json"):
    """JSON of a public tokenizer, read by the driver and sent with the tasks (1.6 MB)."""
    import public_tokenizers
    with open(public_tokenizers.path(name), encoding="utf-8") as file:
        return file.read()


def same_ranks():
    """The same vocabulary as ranks (0.8 MB), for Latin texts."""
    import public_tokenizers
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return {"ranks": file.read(), "pattern": public_tokenizers.PATTERN}


@query
def op2_lm_scoring(spark, sf_dir):
    return score_documents(table(spark, sf_dir, "documents"), modulus=10)


@query
def op3_packing(spark, sf_dir):
    pieces = pack_documents(table(spark, sf_dir, "documents"), tokenizer_spec(), window=2048, end_id=1,
                            **same_ranks())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset")


@query
def op4_url_filter(spark, sf_dir):
    """Pages are labelled by the document whose number their path ends in: low quality or toxic is to block."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract("url", "^[^?#]*/([0-9]+)", 1).try_cast("long")
    labels = table(spark, sf_dir, "labels").select("doc_id", F.expr(
        "cast(quality = 0 or toxic = 1 as int)").alias("blocked"))
    labelled = pages.select("page_id", number.alias("doc_id")).join(labels, "doc_id").select("page_id", "blocked")
    return judge_urls(pages, labelled)


@query
def op5_simhash(spark, sf_dir):
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=3)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op6_sentencepiece(spark, sf_dir):
    """Ids of every text, and the digest of the text that they decode to."""
    import public_tokenizers
    model = public_tokenizers.path("piece_bpe_32k.model")
    coded = encode_documents(table(spark, sf_dir, "documents"), model)
    return decode_documents(coded, model).select(
        "doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


@query
def op7_quality_classifier(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), modulus=5, cut=0.3)


@query
def op8_line_dedup(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=50, count="n_deleted")


@query
def op9_quality_rules(spark, sf_dir):
    judged = judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines",
                         "rules.n_repeat_words", "rules.base_failed", "rules.kept",
                         "rules.n_lines_removed", "rules.lost_share")


@query
def op10_embedding_near_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.93)


@query
def op11_hard_negatives(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr(
        "if(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return mine_hard_negatives(vectors, F.col("id") % 100 == 0, positives=5, negatives=10, share=(30, 90))


ORACLES["op11_hard_negatives"] = """with kept as (
        select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
            list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
        where label is not null and embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (select a.vec_id as anchor_id, o.vec_id as id, a.label = o.label as same,
            list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * o.v[i]))::bigint as score
        from kept a join kept o on a.vec_id != o.vec_id where a.vec_id % 100 = 0),
    positives as (select anchor_id, id as positive_id, score as positive_score from scored where same
        qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
    select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, id))::int as rank,
        id as negative_id, positive_score, score as negative_score
    from positives join scored using (anchor_id)
    where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
    qualify rank <= 10"""


@query
def op12_warc(spark, sf_dir):
    """Pages written to archives in the shared folder and read back; sizes and digests are those of the payloads read."""
    path = fresh_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path, least=0)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1).try_cast("long")
    return resolve_revisits(read_archives(spark, path)).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        number("refers_to").alias("refers_to"))


ORACLES["op12_warc"] = """with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes,
        list_transform(range(8), lambda j: ('0x' || sha1(coalesce(html, ''))[5 * j + 1 : 5 * j + 5])::bigint) as words from pages),
    d as (select page_id, payload_bytes, array_to_string(list_transform(words, lambda w: array_to_string(list_transform([15, 10, 5, 0],
        lambda s: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((w >> s) & 31) + 1]), '')), '') as payload_digest from p),
    t as (select *, max(page_id) over (partition by payload_digest) as top from d)
    select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type,
        case when page_id != top then top end as refers_to from t"""


@query
def op13_vector_codes(spark, sf_dir):
    found = compress_vectors(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2)
    return found.select("vec_id", "code", "error", "label_error", F.sha2("codebooks", 256).alias("codebooks_sha256"))


def _lloyd_sql(parts=16, entries=64, rounds=2):
    """The same in SQL: every part compared with every entry in every round."""
    assign = """a{r} as (select vec_id, label, p, x, min(struct_pack(d := d, k := k)) as best from (
        select o.vec_id, o.label, o.p, o.x, b.k, list_sum(list_transform(range(1, len(o.x) + 1),
            lambda i: (o.x[i] - b.x[i]) * (o.x[i] - b.x[i])))::bigint as d
        from points o join b{r} b on o.p = b.p) group by vec_id, label, p, x)"""
    move = """b{n} as (select b.p, b.k, coalesce(m.x, b.x) as x from b{r} b left join (
        select p, k, list(x order by i) as x from (
            select p, best.k as k, i, floor(sum(x[i]) / count(*))::bigint as x
            from a{r}, unnest(range(1, len(x) + 1)) t(i) group by all) group by p, k) m on m.p = b.p and m.k = b.k)"""
    steps = [f"""kept as (select vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
            from embeddings where embedding is not null and len(embedding) > 0
            and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        points as (select vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] as x
            from kept, unnest(range({parts})) t(p)),
        b0 as (select p, dense_rank() over (order by vec_id) - 1 as k, x from points
            where vec_id in (select vec_id from kept order by vec_id limit {entries}))"""]
    for r in range(rounds):
        steps += [assign.format(r=r), move.format(r=r, n=r + 1)]
    steps.append(assign.format(r=rounds))
    return f"""with {", ".join(steps)},
        coded as (select vec_id, label, string_agg(printf('%02x', best.k), '' order by p) as code,
            sum(best.d)::bigint as error from a{rounds} group by vec_id, label),
        book as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, k)) as codebooks_sha256 from b{rounds})
        select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
        from coded, book"""


ORACLES["op13_vector_codes"] = _lloyd_sql()
