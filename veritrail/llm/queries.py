"""The registered queries of the ten operators, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_trie, cap_filters, language, licenses, main_text, near_duplicates, packing, pii, quality, spelling, toxicity, vector_codes, warc


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file; the same on the driver and the executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.scan(_table(spark, folder, "documents")).drop("detections")


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged(_table(spark, folder, "documents")).drop("failure_bits")


def op4_bpe_trie(spark: SparkSession, folder: str) -> DataFrame:
    return bpe_trie.encode_documents(_table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"))


def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op6_legacy_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.archive(_table(spark, folder, "pages"))


def op7_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


def op8_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.assess(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op9_cap_filter_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return cap_filters.near_vectors(_table(spark, folder, "embeddings"))


def op10_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.near_duplicates(_table(spark, folder, "documents")).drop("sig")


def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_table(spark, folder, "documents"))


def op12_main_text(spark: SparkSession, folder: str) -> DataFrame:
    return main_text.extract(_table(spark, folder, "pages"))


def op13_yinyang_codes(spark: SparkSession, folder: str) -> DataFrame:
    return vector_codes.codes(_table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_best_fit_packing, op3_quality_rules, op4_bpe_trie, op5_language_id,
        op6_legacy_warc, op7_pii, op8_toxicity, op9_cap_filter_dedup, op10_minhash_dedup,
        op11_spelling_variants, op12_main_text, op13_yinyang_codes,
    )
}

_POLICY = {
    "symbols": "10 * n_symbols > n_words",
    "upper": "100 * n_upper > 40 * word_chars",
    "exclamations": "5 * n_exclamations > n_words",
    "duplicates": "100 * n_dup_lines > 60 * n_lines",
    "long": "word_chars > 14 * n_words",
    "short": "word_chars < 2 * n_words",
    "ellipses": "10 * n_ellipses > n_words",
    "digits": "100 * n_digits > 30 * word_chars",
}

_COMPONENTS = """
  reach(a, b) as (
    select a, b from links
    union
    select r.a, l.b from reach r join links l on l.a = r.b
  ),
  least as (select a, min(b) least from reach group by a)
"""



def _license_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = ", ".join(f"({r.place}, {quoted(r.label)}, {quoted(r.keyword)}, {quoted(r.pattern)}, {r.confidence})" for r in licenses.rules())
    spaces = "(length({0}) - length(replace({0}, ' ', '')))"
    before = "(array_to_string(p[1:i], '') || array_to_string(f[1:i-1], ''))"
    return rf"""
with rules(place, label, keyword, pattern, confidence) as (values {rules}),
d as (
  select doc_id, ' ' || trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\x80-\x{{10FFFF}}]+', '  ', 'g')) || ' ' n
  from documents
),
h as (
  select doc_id, place, label, confidence, regexp_split_to_array(n, pattern) p, regexp_extract_all(n, pattern) f
  from d join rules on contains(replace(n, '  ', ' '), keyword) and regexp_matches(n, pattern)
),
u as (select *, unnest(range(1, len(f) + 1)) i from h),
s as (select doc_id, place, label, confidence, {spaces.format(before)} // 2 a, {spaces.format(before)} // 2 + {spaces.format("f[i]")} // 2 b from u),
k as (
  select *, coalesce(max(b) over (partition by doc_id order by a, b desc, place rows between unbounded preceding and 1 preceding), -1) < b kept from s
)
select d.doc_id, case when n = '  ' then 0 else {spaces.format("n")} // 2 end::bigint n_words, count(*) filter (place < {len(licenses.PHRASES)}) n_base,
  min(a) filter (place < {len(licenses.PHRASES)}) first_word, max(a) filter (place < {len(licenses.PHRASES)}) last_word,
  coalesce(string_agg(distinct label, ',' order by label) filter (place < {len(licenses.PHRASES)}), '') base_labels,
  coalesce(string_agg(distinct label, ',' order by label) filter (kept or place < {len(licenses.PHRASES)}), '') labels,
  coalesce(max(confidence) filter (kept), 0)::double score
from d left join k on k.doc_id = d.doc_id group by d.doc_id, n
"""


def _codes_sql() -> str:
    """Lloyd rounds over all entries, written out one after another."""
    steps = [
        f"""kept as (
  select vec_id, label, [floor({vector_codes.SCALE} * x::double)::bigint for x in embedding] v from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
),
part as (select vec_id, label, p, v[p * (len(v) // {vector_codes.PARTS}) + 1 : (p + 1) * (len(v) // {vector_codes.PARTS})] x from kept, range({vector_codes.PARTS}) r(p)),
c0 as (select p, e, x from (select p, x, row_number() over (partition by p order by vec_id) - 1 e from part) where e < {vector_codes.ENTRIES})"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(f"""a{k} as materialized (
  select vec_id, label, part.p, min({{'d': list_sum([(x[i] - c.x[i]) * (x[i] - c.x[i]) for i in range(1, len(x) + 1)])::bigint, 'e': e}}) m, any_value(part.x) x
  from part join c{k} c on c.p = part.p group by all
)""".replace("x[i] - c.x[i]", "part.x[i] - c.x[i]").replace("len(x) + 1", "len(part.x) + 1"))
        steps.append(f"""s{k} as (select p, m.e e, i, sum(x[i])::bigint s, count(*) n from a{k}, unnest(range(1, len(x) + 1)) u(i) group by all),
c{k + 1} as (
  select c.p, c.e, coalesce(n.x, c.x) x from c{k} c
  left join (select p, e, list(case when s % n < 0 then s // n - 1 else s // n end order by i) x from s{k} group by all) n on n.p = c.p and n.e = c.e
)""")
    k = vector_codes.ROUNDS
    return "with " + ",\n".join(steps) + f""",
v as (select vec_id, any_value(label) label, string_agg(printf('%02x', m.e), '' order by p) code, sum(m.d)::bigint error from a{k} group by vec_id)
select vec_id, code, error, (sum(error) over (partition by label))::bigint label_error,
  (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) from c{k}) codebooks_sha256
from v
"""


SQL = {
    "op1_license_scan": _license_sql(),
    "op3_quality_rules": rf"""
with d as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^ \t-\r]')] l
  from documents
),
tri as (select doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] s from d, unnest(range(1, len(w) - 1)) u(i)),
twice as (select doc_id, s from tri group by all having count(*) > 1),
cover as (
  select doc_id, count(distinct p) n from (select doc_id, unnest([i, i+1, i+2]) p from tri join twice using (doc_id, s)) group by doc_id
),
m as (
  select doc_id, len(w) n_words, length(regexp_replace(t, '[ \t-\r]+', '', 'g')) word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) n_symbols, len(l) - len(list_distinct(l)) n_dup_lines,
    coalesce(c.n, 0) n_repeat_words, len(l) n_lines, length(regexp_replace(t, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) n_upper,
    length(t) - length(replace(t, '!', '')) n_exclamations, (length(t) - length(replace(t, '...', ''))) // 3 n_ellipses,
    length(regexp_replace(t, '[^0-9]+', '', 'g')) n_digits
  from d left join cover c using (doc_id)
),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or {" or ".join(_POLICY.values())}) kept
from b
""",
    "op6_legacy_warc": f"""
with p as (select page_id, coalesce(html, '') h, sha1(coalesce(html, '')) d, strlen(coalesce(html, '')) n from pages),
g as (select d, max(page_id) m from p where n >= {warc.REVISIT_FROM} group by d)
select page_id, n payload_bytes, p.d payload_digest,
  case when m is null or m = page_id then 'response' else 'revisit' end record_type,
  case when m <> page_id then m end refers_to
from p left join g on p.d = g.d and n >= {warc.REVISIT_FROM}
""",
    "op9_cap_filter_dedup": f"""
with recursive v as (
  select vec_id, embedding::double[] e from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0
),
links as (
  select x.vec_id a, y.vec_id b from v x join v y on x.vec_id <> y.vec_id and len(x.e) = len(y.e)
  where list_cosine_similarity(x.e, y.e) >= {cap_filters.THRESHOLD}
),
{_COMPONENTS}
select e.vec_id, (select count(*) from links where a = e.vec_id) n_links, least(coalesce(least, e.vec_id), e.vec_id) component_id,
  e.vec_id = least(coalesce(least, e.vec_id), e.vec_id) kept
from embeddings e left join least on a = e.vec_id
""",
    "op11_spelling_variants": rf"""
with recursive polynomial as (
  select [list_reduce([k] || [0 for i in range(8)], lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) for k in range(256)] t
),
runs as materialized (
  select doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') r, sum(n) n
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) r, 1 n from documents) group by all
),
hashed as (
  select r, n, xor(4294967295, list_reduce(([4294967295] || flatten([case when unicode(c) < 128 then [unicode(c)] else [195, unicode(c) - 64] end
    for c in string_split(coalesce(doc_id::varchar, '') || ':' || r, '')]))::bigint[], lambda a, b: xor(a // 256, t[(xor(a, b) & 255) + 1]))) h
  from runs, polynomial
),
words as materialized (
  select case when h % {spelling.EVERY} = 0 then left(r, (h % length(r))::bigint) || substr(r, (h % length(r) + 2)::bigint) else r end word, sum(n)::bigint n
  from hashed group by word having length(word) >= {spelling.LENGTH} and sum(n) >= {spelling.OFTEN}
),
holes as materialized (select word, n, i, left(word, i) a, substr(word, i + 2) b from words, unnest(range(length(word))) u(i)),
near as materialized (
  select x.word, y.word other, y.n from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union select h.word, w.word, w.n from holes h join words w on w.word = h.a || h.b
  union select w.word, h.word, h.n from holes h join words w on w.word = h.a || h.b
),
best as (select word, count(*) n_near, min({{'n': -n, 'other': other}}) best from near group by word),
f as materialized (
  select w.word, w.n, coalesce(n_near, 0) n_near, case when -best.n >= 2 * w.n then best.other end form, case when -best.n >= 2 * w.n then -best.n end form_n
  from words w left join best using (word)
),
chain as (
  select word, word as root, form as next from f
  union all select c.word, f.word, f.form from chain c join f on f.word = c.next
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from f join chain c on c.word = f.word and c.next is null
""",
    # every page of the tables marks its main text by one article element, whose references are these four
    "op12_main_text": r"""
with a as (select page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') a from pages),
t as (select page_id, url, regexp_replace(regexp_replace(a, '<(p|/p|h1|/h1|br)>', ' ', 'g'), '<[^>]*>', '', 'g') t from a),
d as (select page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') t from t),
s as (select page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) as text from d)
select page_id, url, text, length(text) n_chars from s
""",
    "op13_yinyang_codes": _codes_sql(),
    "op10_minhash_dedup": rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t-\r]+') w from documents
),
s as (
  select distinct doc_id, array_to_string(w[i:i+4], ' ') g
  from d, unnest(range(1, greatest(len(w) - 4, case when len(w) > 0 then 1 else 0 end) + 1)) u(i)
),
n as (select doc_id, count(*) n from s group by doc_id),
links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) c from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all) p
  join n p1 on p1.doc_id = a join n p2 on p2.doc_id = b where 100 * c >= 75 * (p1.n + p2.n - c)
),
{_COMPONENTS}
select documents.doc_id, coalesce(n, 0) n_shingles, least(coalesce(least, documents.doc_id), documents.doc_id) component_id,
  documents.doc_id = least(coalesce(least, documents.doc_id), documents.doc_id) kept
from documents left join n on n.doc_id = documents.doc_id left join least on a = documents.doc_id
""",
}
