"""The registered query of each operator, and the SQL that it must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, exact_dedup, fixity, licenses, line_dedup, mixing, near_dedup, packing, pii, quality, secrets, toxicity, whitening
from .common import new_path, read_table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(read_table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_common_words",
        F.sha2(F.coalesce("clean_text", F.lit("")), 256).alias("clean_sha256"),
    )


OP2_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
w as (select doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
win as (select doc_id, i, array_to_string(ws[i:i + 7], ' ') as g from w, unnest(range(1, len(ws) - 6)) as u(i)),
rep as (select doc_id, i from win qualify count(*) over (partition by doc_id, g) >= 2),
cov as (select doc_id, count(distinct i + k) as n from rep, unnest(range(0, 8)) as v(k) group by 1),
ln as (select doc_id, source, t, unnest(string_split(t, chr(10))) as line, generate_subscripts(string_split(t, chr(10)), 1) as i from d),
lw as (select doc_id, source, t, line, i,
         trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm,
         len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) as n
       from ln where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select doc_id, count(*) - count(distinct line) as n from lw group by 1),
ks as (select unnest(range(0, {quality.GROUPINGS})) as k),
grp as (select source, t, k, min(substring(sha256(norm), 1 + {quality.DIGITS} * k, {quality.DIGITS})) as grp from lw, ks group by 1, 2, 3),
host as (select source, count(distinct t) as n from d group by 1),
hostk as (select d.source, d.k, count(distinct coalesce(grp, '')) as n from (select * from d, ks) d left join grp on d.source is not distinct from grp.source and d.t = grp.t and d.k = grp.k group by 1, 2),
able as (select lw.source, norm from lw join host on lw.source is not distinct from host.source group by lw.source, norm, host.n
         having count(distinct lw.t) >= {quality.COMMON_DOCS} and 100 * count(distinct lw.t) > {quality.COMMON_PERCENT} * host.n),
ck as (select lw.source, lw.norm, grp.k from lw join able on lw.source is not distinct from able.source and lw.norm = able.norm
       join grp on lw.source is not distinct from grp.source and lw.t = grp.t join hostk on lw.source is not distinct from hostk.source and grp.k = hostk.k
       group by lw.source, lw.norm, grp.k, hostk.n having count(distinct grp) >= {min(quality.COMMON_DOCS, quality.COMMON_GROUPS)} and 100 * count(distinct grp) > {quality.COMMON_PERCENT} * hostk.n),
com as (select source, norm from ck group by 1, 2 having 2 * count(*) > {quality.GROUPINGS}),
hit as (select doc_id, i, n from lw join com on lw.source is not distinct from com.source and lw.norm = com.norm),
lost as (select doc_id, sum(n) as n from hit group by 1),
clean as (select ln.doc_id, coalesce(string_agg(line, chr(10) order by ln.i) filter (hit.doc_id is null), '') as t
          from ln left join hit on ln.doc_id = hit.doc_id and ln.i = hit.i group by 1),
f as (select w.doc_id, len(ws)::bigint as n_words,
        length(regexp_replace(w.t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
        len(regexp_extract_all(w.t, '[#*$%&|<>]'))::bigint as n_symbols,
        coalesce(dup.n, 0)::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
        coalesce(lost.n, 0)::bigint as n_common_words, sha256(clean.t) as clean_sha256
      from w left join cov using (doc_id) left join dup using (doc_id) left join lost using (doc_id) left join clean using (doc_id)),
g as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not 100 * n_common_words > {quality.DEPLETED_PERCENT} * n_words as kept, n_common_words, clean_sha256
from g
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", F.col("mix_copy").cast("int").alias("mix_copy"), "mix_key")


OP4_SQL = rf"""
with recursive s as (select source, sum(length(coalesce(text, '')))::double as size from documents group by 1),
t as (select *, sqrt(size) as weight from s),
r as (select source, case when size = 0 then 1.0 else weight * (select sum(size) from t) / (select sum(weight) from t) / size end as rate from t),
p as (select source, rate, 0 as k, exp(-rate) as prob, exp(-rate) as cdf from r
      union all select source, rate, k + 1, prob * rate / (k + 1), cdf + prob * rate / (k + 1) from p
      where k < ceil(rate + {mixing.TAIL_ROOTS} * sqrt(rate) + {mixing.TAIL_STEPS})),
i as (select doc_id, source, coalesce(doc_id::varchar, sha256(coalesce(source, '-') || chr(10) || coalesce(text, ''))) as id from documents),
d as (select *, ('0x' || md5('{mixing.SEED}-count' || chr(10) || id)[1:{mixing.UNIFORM_DIGITS}])::bigint / (16.0::double ** {mixing.UNIFORM_DIGITS}) as u from i),
n as (select d.doc_id, d.source, d.id, count(p.k) as n from d join p on d.source is not distinct from p.source and p.cdf <= d.u group by 1, 2, 3)
select doc_id, source, c::int as mix_copy, md5('{mixing.SEED}' || chr(10) || id || chr(10) || c::varchar) as mix_key
from n, unnest(range(0, n)) as u(c)
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("pii_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{k}") for k in pii.KINDS),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("pii_spans")).alias("spans"),
    )


#: The contract's patterns as they stand there, groups not captured, by rank.
BASE_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
)
EACH_KIND = " union all ".join(
    f"select t, '{k}' as kind, {i} as rank, regexp_extract_all(t, '{p}') as found, string_split_regex(t, '{p}') as parts from texts" for i, (k, p) in enumerate(BASE_PATTERNS)
)
OP5_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
texts as (select distinct t from d),
kinds as ({EACH_KIND}),
raw as (select t, kind, rank, n, found[n] as value, parts[n] as before, parts[n + 1] as after,
          sum(length(parts[n]) + length(found[n])) over (partition by t, kind order by n) as stop from kinds, unnest(range(1, len(found) + 1)) as u(n)),
dig as (select *, regexp_replace(value, '[^0-9]', '', 'g') as digits from raw),
m as (select t, kind, rank, value, before, after, stop - length(value) as start, stop from dig where case kind
  when 'ip' then list_max(list_transform(string_split(value, '.'), lambda x: x::hugeint)) <= 255
  when 'card' then length(digits) between 14 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i:
    case when (length(digits) - i) % 2 = 0 then digits[i]::int when digits[i]::int > 4 then digits[i]::int * 2 - 9 else digits[i]::int * 2 end)) % 10 = 0
  when 'phone' then length(digits) between 10 and 15 else true end),
side as (select t, kind, value, right(before, {pii.CONTEXT_CHARS}) as c from m union all select t, kind, value, left(after, {pii.CONTEXT_CHARS}) from m),
cut as (select t, kind, value, unnest(string_split_regex(c, '{pii.CUT}')[2:-2]) as w from side),
core as (select distinct t, kind, value, lower(regexp_replace(w, '^{pii.JOINER}+|{pii.JOINER}+$', '', 'g')) as term from cut),
terms as (select * from core where regexp_matches(term, '\p{{L}}') and not contains(term, '@')),
tok as (select t, unnest(string_split_regex(t, '{pii.CUT}')) as w, unnest(range(0, len(string_split_regex(t, '{pii.CUT}')))) as i from texts),
at_ as (select t, w, i + coalesce(sum(length(w)) over (partition by t order by i rows between unbounded preceding and 1 preceding), 0) as place,
          regexp_replace(w, '^{pii.JOINER}+|{pii.JOINER}+$', '', 'g') as core, length(w) - length(regexp_replace(w, '^{pii.JOINER}+', '')) as lead_ from tok),
n_t as (select lower(core) as term, count(distinct t) as n from at_ where lower(core) in (select term from terms) group by 1),
n_e as (select kind, value, count(distinct t) as n from m group by 1, 2),
n_et as (select kind, value, term, count(distinct t) as n from terms group by 1, 2, 3),
told as (select distinct term from n_et join n_e using (kind, value) join n_t using (term), (select count(*) as n from texts) as every
         where n_e.n < every.n and 1 + ln(n_et.n / greatest(n_t.n, n_et.n)::double) / ln(every.n::double / n_e.n) >= {pii.GENERALISE_FROM}),
sp as (select t, kind, rank, start, stop from m union all
       select t, 'term', {len(BASE_PATTERNS)}, place + lead_, place + lead_ + length(core) from at_ where lower(core) in (select term from told)),
g as (select t, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (kind <> 'term'), '') as base,
        {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k, _ in BASE_PATTERNS)} from sp group by 1)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k, _ in BASE_PATTERNS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (t)
"""


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.dedupe(docs).select("doc_id", "class_id", "kept")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return licenses.scan(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _rows(*rows: tuple) -> str:
    """The rows of a VALUES list."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


LONGEST = max(len(p.split()) for p in licenses.PHRASES)
OP7_SQL = rf"""
with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.SEPARATORS}'), lambda x: x <> '') as ws from documents),
ph as (select string_split(p, ' ') as ps, label from (values {_rows(*licenses.PHRASES.items())}) as v(p, label)),
wd as (select doc_id, i, ws[i] as x, ws[i:i + {LONGEST - 1}] as xs, array_to_string(ws[i:i + {licenses.GRAM - 1}], ' ') as g, len(ws) - i + 1 as n
       from w, unnest(range(1, len(ws) + 1)) as u(i)),
base as (select doc_id, i - 1 as pos, label from wd join ph on wd.x = ps[1] and xs[1:len(ps)] = ps),
t as (select template, label, list_filter(regexp_split_to_array(translate(txt, '{licenses.UPPER}', '{licenses.LOWER}'), '{licenses.SEPARATORS}'), lambda x: x <> '') as tw
      from (values {_rows(*((k, *v) for k, v in licenses.TEMPLATES.items()))}) as v(template, label, txt)),
tg as (select template, j, array_to_string(tw[j:j + {licenses.GRAM - 1}], ' ') as g from t, unnest(range(1, len(tw) - {licenses.GRAM - 2})) as u(j)),
votes as (select doc_id, template, i - j as diag, min(i) as lo, max(i) as hi from wd join tg using (g) where wd.n >= {licenses.GRAM} group by all),
b1 as (select *, coalesce(diag - lag(diag) over (partition by doc_id, template order by diag) > {licenses.SHIFT}, true) as far from votes),
b2 as (select *, sum(far::int) over (partition by doc_id, template order by diag) as band from b1),
b3 as (select *, coalesce(lo - max(hi) over (partition by doc_id, template, band order by lo, diag rows between unbounded preceding and 1 preceding) > {licenses.GRAM + licenses.GAP}, true) as fresh from b2),
b4 as (select *, sum(fresh::int) over (partition by doc_id, template, band order by lo, diag) as span from b3),
cov as (select doc_id, template, band, span, count(distinct k) as n from b4 join t using (template) join w using (doc_id), unnest(range(1, len(tw) + 1)) as u(k)
        where k + diag >= 1 and ws[k + diag] = tw[k] group by all),
good as (select doc_id, label, n::double / len(tw) as covered from cov join t using (template) where n::double / len(tw) >= {licenses.COVERAGE}),
bl as (select doc_id, count(*) as n, min(pos) as lo, max(pos) as hi, string_agg(distinct label, ',' order by label) as labels from base group by 1),
every as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from base union select doc_id, label from good) group by 1),
best as (select doc_id, max(covered) as covered from good group by 1)
select doc_id, len(ws)::bigint as n_words, coalesce(bl.n, 0)::bigint as n_base, bl.lo::bigint as first_word, bl.hi::bigint as last_word,
  coalesce(bl.labels, '') as base_labels, coalesce(every.labels, '') as labels, case when bl.n > 0 then 1.0::double else coalesce(covered, 0.0)::double end as score
from w left join bl using (doc_id) left join every using (doc_id) left join best using (doc_id)
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedupe(docs).select("doc_id", "n_lines", "n_removed", "removed_spans", "clean_text")


OP8_SQL = r"""
with raw as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents),
w as (select doc_id, i, row_number() over (partition by doc_id order by i) - 1 as pos,
        trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm
      from raw where regexp_matches(line, '[^\x20\x09-\x0D]')),
win as (select doc_id, pos, norm || chr(10) || lead(norm) over (partition by doc_id order by pos) || chr(10) || lead(norm, 2) over (partition by doc_id order by pos) as g from w),
later as (select doc_id, pos from win where g is not null qualify row_number() over (partition by g order by doc_id, pos) > 1),
gone as (select distinct doc_id, pos + k as pos from later, unnest(range(0, 3)) as u(k)),
isl as (select doc_id, pos, pos - row_number() over (partition by doc_id order by pos) as grp from gone),
sp as (select doc_id, string_agg(lo::varchar || '-' || hi::varchar, ',' order by lo) as spans, sum(hi - lo + 1) as n
       from (select doc_id, grp, min(pos) as lo, max(pos) as hi from isl group by 1, 2) group by 1),
left_over as (select raw.doc_id, string_agg(raw.line, chr(10) order by raw.i) as t from raw
  left join w on raw.doc_id = w.doc_id and raw.i = w.i left join gone on w.doc_id = gone.doc_id and w.pos = gone.pos
  where gone.doc_id is null group by 1),
n as (select doc_id, count(*) as n from w group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint as n_lines, coalesce(sp.n, 0)::bigint as n_removed, coalesce(sp.spans, '') as removed_spans,
  case when sp.n is null then d.text else coalesce(l.t, '') end as clean_text
from documents d left join n using (doc_id) left join sp using (doc_id) left join left_over l using (doc_id)
"""


def op9_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = fixity.warc_records(read_table(spark, sf_dir, "pages"))
    told = fixity.report(records, fixity.damaged(records))
    return told.select(F.col("record_no").alias("page_id"), "archive", "lo", "hi", "record_sha256", "status")


OP9_SQL = rf"""
with r as (select page_id, page_id // {fixity.ARCHIVE_RECORDS} as archive,
  'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
  || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
  || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
  || coalesce(html, '') as record from pages),
s as (select page_id, archive, strlen(record) + 4 as n, sha256(record) as h from r),
o as (select *, sum(n) over w - n as lo, sum(n) over w as hi, sum((h[1:2] = '01')::int) over w as lost
      from s window w as (partition by archive order by page_id))
select page_id, archive, lo::bigint as lo, hi::bigint as hi, h as record_sha256,
  case when h[1:2] = '01' then 'missing' when h[1:2] = '00' then 'corrupt' when lost > 0 then 'moved' else 'intact' end as status
from o
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_dedup.dedupe(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP10_SQL = r"""
with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  row_number() over (partition by t order by doc_id) = 1 as kept, sha256(t) as text_sha256
from d
"""

def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    model = whitening.fit(rows)
    told = (model.n, model.explained, model.identity_error) if model else (0, [], 0.0)
    each = whitening.apply(rows, model).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    shares = F.lit(told[1]) if told[1] else F.array().cast("array<double>")
    return each.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(told[0]).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(told[2]).alias("identity_error"),
    )


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), new_path(spark, "-ledger"))
    of_kind = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["rank"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        *(of_kind(k).alias(f"n_{k}") for k in secrets.BASE),
        F.sha2(pii.listed(base), 256).alias("base_sha256"),
        pii.listed(F.col("secret_spans")).alias("spans"),
    )


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: The contract's patterns as they stand there, groups not captured, letters in either case as classes.
SECRET_PATTERNS = (
    (
        "assign",
        r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
        r"""^[^:=]*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6}""",
    ),
    ("access", "AKIA[A-Z0-9]+", "^.{20}"),
    ("hex", "[0-9a-f]+", "^.{24}"),
)
#: The operator's own rules, runs of characters without look-behind.
PLAIN_RUNS = {"jwt": "[A-Za-z0-9_.-]+"}
SECRET_RULES = (*SECRET_PATTERNS, *((r.kind, PLAIN_RUNS.get(r.kind, r.pattern), r.keep) for r in secrets.RULES if r.kind not in secrets.BASE))
EACH_SECRET = " union all ".join(
    f"select t, '{k}' as kind, {i} as rank, {_literal(keep)} as keep, regexp_extract_all(t, {_literal(p)}) as found, string_split_regex(t, {_literal(p)}) as parts from texts"
    for i, (k, p, keep) in enumerate(SECRET_RULES)
)
OP12_SQL = rf"""
with d as (select doc_id, coalesce(text, '') as t from documents),
texts as (select distinct t from d),
kinds as ({EACH_SECRET}),
raw as (select t, kind, rank, keep, found[n] as value, sum(length(parts[n]) + length(found[n])) over (partition by t, kind order by n) as stop
        from kinds, unnest(range(1, len(found) + 1)) as u(n)),
m as (select *, stop - length(value) as start from raw where regexp_matches(value, keep)),
g as (select t, string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) as spans,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' order by start, rank) filter (rank < {len(SECRET_PATTERNS)}), '') as base,
        {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k, _, _ in SECRET_PATTERNS)} from m group by 1)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k, _, _ in SECRET_PATTERNS)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (t)
"""

def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(read_table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = rf"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
tok as (select r, lang, source, w, count(*) as n from (select r, lang, source, unnest(ws) as w from d) group by all),
kept as (select lang, w, sum(n)::hugeint as n from tok group by 1, 2 having count(*) >= {divergence.MIN_DOCS}),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from kept group by 1),
g as (select distinct lang, source from d),
c as (select tok.lang, source, tok.w, sum(tok.n)::hugeint as n from tok semi join kept on tok.lang = kept.lang and tok.w = kept.w group by 1, 2, 3),
gn as (select g.lang, g.source, coalesce(sum(c.n), 0)::hugeint as n from g left join c using (lang, source) group by 1, 2),
p as (select gn.lang, gn.source, kept.w, coalesce(c.n, 0) as n, 1 + ({divergence.UNIT}::hugeint * (coalesce(c.n, 0) + {divergence.SMOOTHING})) // (gn.n + {divergence.SMOOTHING} * v.v) as p
      from gn join v using (lang) join kept using (lang) left join c on gn.lang = c.lang and gn.source = c.source and kept.w = c.w),
q as (select lang, w, 1 + ({divergence.UNIT}::hugeint * (kept.n + {divergence.SMOOTHING})) // (v.n + {divergence.SMOOTHING} * v.v) as q from kept join v using (lang)),
apart as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.w = b.w and a.source <> b.source group by 1, 2, 3),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
          from g a join g b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
          union all select p.lang, p.source, 'term', p.w, (p.p - q.q)::bigint from p join q on p.lang = q.lang and p.w = q.w where p.n > 0 and p.p > q.q),
ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from every)
select * from ranked where part = 'pair' or rank <= {divergence.TOP_TERMS}
"""


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_source_mixing": op4_source_mixing,
    "op5_pii": op5_pii,
    "op6_minhash_near_dedup": op6_minhash_near_dedup,
    "op7_license_scan": op7_license_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_warc_fixity": op9_warc_fixity,
    "op10_exact_dedup": op10_exact_dedup,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_secret_scan": op12_secret_scan,
    "op13_source_divergence": op13_source_divergence,
}
ORACLES = {
    "op2_quality_rules": OP2_SQL,
    "op4_source_mixing": OP4_SQL,
    "op5_pii": OP5_SQL,
    "op7_license_scan": OP7_SQL,
    "op8_line_dedup": OP8_SQL,
    "op9_warc_fixity": OP9_SQL,
    "op10_exact_dedup": OP10_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_source_divergence": OP13_SQL,
}
