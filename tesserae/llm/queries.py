"""The registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import band_join, bpe, decontaminate, licenses, minhash, pii, quality, sharding, spelling, spotsigs, substring_dedup, suffix_dedup, toxicity
from tesserae.llm.common import short_batches


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 contiguous shards of nearly equal bytes."""
    placed = sharding.assign_shards(_documents(spark, sf_dir), n_shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text."""
    return spotsigs.edited_fingerprints(_documents(spark, sf_dir))


def tokenizer_path() -> str:
    """The installed vocabulary file that the queries take."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, and the text decoded from them, as digests."""
    return bpe.round_trip(_documents(spark, sf_dir), tokenizer_path())


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents over 2-word shingles."""
    return minhash.near_duplicates(_documents(spark, sf_dir), shingle=2, percent=80)


def _held_out(n: int, remainder: int):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n == remainder


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learnt from the labels that aren't held out."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels.filter(~_held_out(5, 0)))
    return quality.score(docs, model).select("doc_id", _held_out(5, 0).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents, learnt from the labels that aren't held out."""
    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels.filter(~_held_out(3, 1)))
    return toxicity.score(docs, model).select("doc_id", _held_out(3, 1).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate blocks of every whole text, and the licenses confirmed in them."""
    found = licenses.scan(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_blocks"),
        F.size(F.filter("licenses", lambda b: b["license"].isNotNull())).cast("long").alias("n_confirmed"),
        F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform("licenses", lambda b: b["license"]), lambda x: x.isNotNull()))), ",").alias("licenses"),
        F.array_join(F.transform("licenses", lambda b: F.concat_ws(":", F.coalesce(b["license"], F.lit("?")), b["start"].cast("string"), b["end"].cast("string"))), ",").alias("blocks"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in 13-word windows of benchmark items."""
    found = decontaminate.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.withColumn("items_sha256", F.sha2(F.array_join("items", ",").cast("binary"), 256)).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the rules' spans, and all spans."""
    found = pii.find(_documents(spark, sf_dir).select("doc_id", "text")).drop("text")
    rules = F.filter("pii", lambda s: s["rule"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["rule"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *map(count, pii.KINDS),
        F.sha2(joined(rules).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("pii")).alias("spans"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every whole text in 400-byte strings that start elsewhere too; and whether 50 words in a row are another document's too."""
    docs = _documents(spark, sf_dir)
    sharing = suffix_dedup.sharing_documents(docs, words=suffix_dedup.PASSAGE).select(F.col("id").alias("doc_id"), F.lit(1).alias("shares_passage"))
    return suffix_dedup.remove_repeats(docs, length=400).join(sharing, "doc_id", "left").withColumn("shares_passage", F.coalesce("shares_passage", F.lit(0)))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every whole text in 13-word windows that a document of a smaller id holds too."""
    return substring_dedup.remove_passages(_documents(spark, sf_dir))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all texts, each 31st run with a code point less, with their near words, forms and roots."""
    return spelling.spelling_variants(_documents(spark, sf_dir), noise=31).select("word", "form", "root", "n", "n_near", "form_n")


def op13_band_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five lines of near unit price of every item, and sums over all of them."""
    return band_join.near_lines(spark.read.parquet(f"{sf_dir}/sale_lines.parquet"), spark.read.parquet(f"{sf_dir}/items.parquet"))


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_spotsigs": op2_spotsigs,
    "op3_bpe": op3_bpe,
    "op4_minhash": op4_minhash,
    "op5_quality": op5_quality,
    "op6_toxicity": op6_toxicity,
    "op7_licenses": op7_licenses,
    "op8_decontamination": op8_decontamination,
    "op9_pii": op9_pii,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_substring_dedup": op11_substring_dedup,
    "op12_spelling": op12_spelling,
    "op13_band_join": op13_band_join,
}

#: A-Z in lower case, and no other letter: what the contracts of op4 and op8 ask for.
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: One row, t: the table of the usual CRC-32, made from its polynomial.
_CRC_TABLE = """crc_table as (select list(c order by i) as t from
 (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, b: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i)))"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8, in SQL that sees ``crc_table``."""
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda k: ('0x' || substring(hex(encode({text})), 2 * k + 1, 2))::bigint)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


ORACLE_SQL: dict[str, str] = {
    "op4_minhash": rf"""with recursive words as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then w else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from words),
sizes as (select doc_id, len(s) as n from sets), laid as (select doc_id, unnest(s) as shingle from sets),
links as (select a.doc_id as a, b.doc_id as b from laid a join laid b using (shingle) join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
 where a.doc_id <> b.doc_id and 100 * least(x.n, y.n) >= 80 * greatest(x.n, y.n) group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
reached as (select doc_id as id, doc_id as seen from documents union select b, seen from reached join links on a = id),
parts as (select id, min(seen) as component_id from reached group by id)
select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from sizes join parts on id = doc_id""",
    "op8_decontamination": rf"""with words as (select doc_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
items as (select item_id, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
windows as (select distinct item_id, n, array_to_string(w[i:i + n - 1], ' ') as win from (select item_id, w, least(13, len(w)) as n, unnest(range(1, len(w) - least(13, len(w)) + 2)) as i from items where len(w) > 0)),
laid as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as win from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i from words, (select distinct n from windows) where len(w) >= n)),
hits as (select doc_id, item_id, i, n from laid join windows using (n, win)),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by doc_id),
held as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item_id::varchar as item from hits) group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from words left join covered using (doc_id) left join held using (doc_id)""",
    "op10_suffix_dedup": """with bytes as (select doc_id, hex(coalesce(text, '')) as x from documents),
strings as (select doc_id, i, md5(substring(x, 2 * i + 1, 800)) as s from (select doc_id, x, unnest(range(0, greatest(0, len(x) // 2 - 399))) as i from bytes)),
twice as (select s from strings group by s having count(*) > 1),
starts as (select doc_id, i, coalesce(i > lag(i) over w + 400, true) as fresh from strings semi join twice using (s) window w as (partition by doc_id order by i)),
numbered as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as run from starts),
runs as (select doc_id, min(i) as low, max(i) + 400 as high from numbered group by doc_id, run),
gaps as (select doc_id, 0 as a, min(low) as b from runs group by doc_id union all select doc_id, high, lead(low) over (partition by doc_id order by low) from runs),
kept as (select doc_id, string_agg(substring(x, 2 * a + 1, 2 * (coalesce(b, len(x) // 2) - a)), '' order by a) as k from gaps join bytes using (doc_id) group by doc_id),
sums as (select doc_id, sum(high - low)::bigint as n_removed, count(*) as n_spans from runs group by doc_id),
words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
passages as (select doc_id, md5(array_to_string(w[i:i + 49], ' ')) as p from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from words where len(w) >= 50)),
sharing as (select distinct doc_id, 1 as shares from passages semi join (select p from passages group by p having count(distinct doc_id) > 1) using (p))
select doc_id, len(x) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, x))) as kept_sha256, coalesce(shares, 0) as shares_passage
from bytes left join sums using (doc_id) left join kept using (doc_id) left join sharing using (doc_id)""",
    "op11_substring_dedup": r"""with words as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
windows as (select doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from words where len(w) >= 13)),
firsts as (select s, min(doc_id) as first from windows group by s),
starts as (select doc_id, i, coalesce(i > lag(i) over k + 13, true) as fresh from windows join firsts using (s) where first < doc_id window k as (partition by doc_id order by i)),
numbered as (select doc_id, i, sum(fresh::int) over (partition by doc_id order by i) as run from starts),
runs as (select doc_id, min(i) as low, max(i) + 13 as high from numbered group by doc_id, run),
gaps as (select doc_id, 1 as a, min(low) as b from runs group by doc_id union all select doc_id, high, lead(low) over (partition by doc_id order by low) from runs),
kept as (select doc_id, string_agg(array_to_string(w[a:coalesce(b, len(w) + 1) - 1], ' '), ' ' order by a) as k from gaps join words using (doc_id) where coalesce(b, len(w) + 1) > a group by doc_id),
sums as (select doc_id, sum(high - low)::bigint as n_removed from runs group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(case when n_removed is null then array_to_string(w, ' ') else coalesce(k, '') end) as kept_sha256
from words left join sums using (doc_id) left join kept using (doc_id)""",
    "op12_spelling": rf"""with recursive {_CRC_TABLE},
runs as (select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r, count(*) as k from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) as r from documents) group by all),
hashed as (select r, k, {_crc32("concat(doc_id, ':', r)")} as h, length(r) as size from runs, crc_table where length(r) >= 7),
made as (select case when h % 31 = 0 then substring(r, 1, h % size) || substring(r, h % size + 2) else r end as word, k from hashed),
words as (select word, sum(k)::bigint as n from made where length(word) >= 7 group by word having sum(k) >= 2),
gaps as (select word, n, i, substring(word, 1, i - 1) || substring(word, i + 1) as rest from (select word, n, unnest(range(1, length(word) + 1)) as i from words)),
near as (select a.word, b.word as other, b.n as other_n from gaps a join gaps b on a.rest = b.rest and a.i = b.i and a.word <> b.word
 union select a.word, b.word, b.n from gaps a join words b on a.rest = b.word union select b.word, a.word, a.n from gaps a join words b on a.rest = b.word),
best as (select word, count(*) over (partition by word) as n_near, other, other_n, row_number() over (partition by word order by other_n desc, other) as k from near),
found as (select word, n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * n then other end as form, case when other_n >= 10 * n then other_n end as form_n from words left join (select * from best where k = 1) using (word)),
followed as (select word, coalesce(form, word) as root from found union select f.word, g.form from followed f join found g on g.word = f.root where g.form is not null),
last as (select f.word, f.root from followed f join found g on g.word = f.root where g.form is null)
select word, form, root, n, n_near, form_n from found join last using (word)""",
    "op13_band_join": f"""with {_CRC_TABLE},
lines as (select sale_id, line_no::bigint as line_no, item_id as line_item_id, (2 * a + quantity) // (2 * quantity) as u, {_crc32("concat(sale_id, ',', line_no, ',', item_id)")} as crc
 from (select *, floor(100 * amount + 0.5)::bigint as a from sale_lines where sale_id is not null and item_id is not null and amount is not null and quantity > 0), crc_table),
asked as (select row_number() over () as row_id, item_id, floor(100 * price + 0.5)::bigint as p from items),
pairs as (select row_id, abs(u - p) as gap, u, sale_id, line_no, line_item_id, crc from asked join lines
 on u between p - greatest(10, p // 500) and p + greatest(10, p // 500) and line_item_id <> item_id where abs(u - p) <= 10 or 1000 * abs(u - p) <= 2 * p),
sums as (select row_id, count(*) as n_pairs, sum(gap)::bigint as gap_sum, sum(crc)::bigint as lines_crc from pairs group by row_id),
ranked as (select *, row_number() over (partition by row_id order by gap, u, sale_id, line_no nulls first, line_item_id) as rank from pairs)
select item_id, coalesce(rank, 0)::int as rank, gap, u, sale_id, line_no, line_item_id, coalesce(n_pairs, 0) as n_pairs, coalesce(gap_sum, 0) as gap_sum, coalesce(lines_crc, 0) as lines_crc
from asked left join sums using (row_id) left join (select * from ranked where rank <= 5) using (row_id)""",
}
