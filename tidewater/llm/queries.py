"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import chat, decontaminate, html, language, linededup, merkle, mixing, rules, simhash, spelling, substring, subwords, syncmers
from tidewater.llm.common import held_out, table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.without_repeated_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("\\### Assistant: </turn> ok")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat.digests(chat.format_conversations(turns))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = subwords.fit(docs, table(spark, sf_dir, "labels"))
    return subwords.scores(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.fit(docs))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return found


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = syncmers.with_next(table(spark, sf_dir, "documents")).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 4 as int)), substring(head, 1, cast(n_chars div 4 as int)))")
    docs = docs.select("doc_id", "n_chars", "sketch", "next_sketch", cut.alias("edited"))
    docs = syncmers.sketched(docs, "edited", "edited_sketch").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    docs = syncmers.likeness(syncmers.likeness(docs, "sketch", "edited_sketch", "near_edited"), "sketch", "next_sketch", "near_next")
    prints = syncmers.fingerprint("sketch").alias("fingerprint"), syncmers.fingerprint("edited_sketch").alias("edited_fingerprint")
    return docs.select("doc_id", "n_chars", "edited_sha256", *prints, "near_edited", "near_next")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    shortened = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered=F.unhex(merkle.leaf(text=shortened)))
    found = found.withColumns({"folded_root": merkle.folded(F.lower(F.hex("tampered"))), "proof_sha256": F.sha2(merkle.siblings(), 256)})
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_quality_rules,
        op2_line_dedup,
        op3_chat_formatting,
        op4_quality_classifier,
        op5_substring_dedup,
        op6_html_extraction,
        op7_language_id,
        op8_source_mixing,
        op9_simhash_dedup,
        op10_decontamination,
        op11_document_fingerprints,
        op12_merkle_manifest,
        op13_spelling_variants,
    )
    return {f.__name__: f for f in found}


WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def _op1_sql() -> str:
    passes = ", ".join(f"len(list_filter({values}, lambda c: c >= {rule}))" for rule, values in rules.CUTOFFS.items())
    return rf"""
with w as (
  select doc_id, lang, coalesce(text, '') as text, {WORDS} as ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] as k from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as i from w)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, k) as n from g) where n > 1),
covered as (select doc_id, count(distinct j) as n from (select doc_id, unnest([i, i + 1, i + 2]) as j from again) group by doc_id),
c as (
  select w.doc_id, lang, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
    coalesce(covered.n, 0)::bigint as n_repeat_words, len(ls) as lines, length(regexp_replace(text, '[^\p{{Lu}}!]+', '', 'g')) as shouts
  from w left join covered using (doc_id)),
s as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when n_words > 0 then n_symbols / n_words else 0 end as symbol_share, case when word_chars > 0 then shouts / word_chars else 0 end as shout_share,
    case when lines > 0 then n_dup_lines / lines else 0 end as dup_line_share, case when n_words > 0 then n_repeat_words / n_words else 0 end as repeat_share
  from c),
good as (select s.* from s join (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1) using (doc_id) where not base_failed),
level as (select unnest(range(0, {rules.LEVELS})) as level),
seen as (select lang, level, count(*) as n, count(*) filter (least({passes}) <= level) as x from good cross join level group by all),
p as (
  select *, list_sum(list_transform(range(0, x + 1), lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln({rules.RISK}) + (n - k) * ln(1 - {rules.RISK})))) as p,
    (select count(distinct coalesce(lang, chr(0))) from good) as strata
  from seen),
stops as (select lang, level, min(level) filter (p > {rules.ERROR} / strata) over (partition by lang) as stop from p),
best as (select lang, max(level) as level from stops where stop is null or level < stop group by lang)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not coalesce(least({passes}) <= level, false) as kept
from s left join best on s.lang is not distinct from best.lang"""


def _op2_sql() -> str:
    most, characters = linededup.LINES, linededup.CHARACTERS
    blanks = "' ' || chr(9) || chr(13) || chr(12) || chr(11)"
    ahead = ", ".join(f"lead(line, {k}) over d as line{k}, lead(i, {k}) over d as i{k}" for k in range(1, most))
    runs = []
    for n in range(1, most + 1):
        lines, places = [f"line{k}" for k in range(n)], ", ".join(f"i{k}" for k in range(n))
        size = " + ".join(f"length({x})" for x in lines)
        enough = f"line{n - 1} is not null" + (f" and {size} >= {characters}" if n < most else "")
        key = ", ".join(lines)
        runs.append(f"select doc_id, [{places}] as lines, row_number() over (partition by {key} order by doc_id, i0) as k from w where {enough}")
    return f"""
with l as (select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i from documents),
s as (select doc_id, i, trim(raw, {blanks}) as line from l where trim(raw, {blanks}) <> ''),
w as (select doc_id, i as i0, line as line0, {ahead} from s window d as (partition by doc_id order by i)),
r as ({" union all ".join(runs)}),
gone as (select distinct doc_id, unnest(lines) as i from r where k > 1),
kept as (select l.doc_id, string_agg(raw, chr(10) order by l.i) as text from l anti join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id)
select d.doc_id, (select count(*) from s where s.doc_id = d.doc_id)::bigint as n_lines, (select count(*) from gone where gone.doc_id = d.doc_id)::bigint as n_removed,
  case when d.text is not null then sha256(coalesce(kept.text, '')) end as text_sha256
from documents d left join kept on kept.doc_id = d.doc_id"""


def _op3_sql() -> str:
    safe = lambda c: f"replace(replace(replace({c}, '&', '&amp;'), '</turn>', '&lt;/turn>'), '###', '##&num;')"  # noqa: E731
    return f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text, case when conv_id is null then row_number() over () end as own from conversations
  union all select -7, 0, 'user', '\\### Assistant: </turn> ok', null union all select -7, 1, 'assistant', '\\### Assistant: </turn> ok', null),
m as (
  select *, row_number() over (partition by conv_id, own order by turn nulls first, role, text) as k,
    lag(role) over (partition by conv_id, own order by turn nulls first, role, text) as was from t),
j as (
  select *, case when k = 1 then role in ('system', 'user') when role = 'user' then was in ('system', 'assistant') when role = 'assistant' then was = 'user' else false end as ok
  from m),
g as (
  select conv_id, count(*)::bigint as n_turns, string_agg(role || chr(10) || text || chr(10), '' order by k) as turns,
    coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '') as loss,
    sum(length('### ' || replace({safe("role")}, ':', '&colon;') || ': ' || {safe("text")} || '</turn>' || chr(10)))::bigint as formatted_chars,
    bool_and(ok) as in_turn, arg_max(role, k) as last
  from j group by conv_id, own)
select conv_id, n_turns, sha256(turns) as turns_sha256, length(loss)::bigint as loss_chars, sha256(loss) as loss_sha256, formatted_chars,
  in_turn and last = 'assistant' as valid,
  case when not in_turn then 'invalid' when last = 'assistant' then 'answered' when last = 'user' then 'asked' else 'told' end as state
from g"""


def _op5_sql() -> str:
    n = substring.WINDOW
    return rf"""
with w as (select doc_id, {WORDS} as ws from documents),
win as (select doc_id, p, array_to_string(ws[p : p + {n - 1}], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - {n - 2})) as p from w)),
later as (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as r from win) where r > 1),
gone as (select distinct doc_id, unnest(range(p, p + {n})) as i from later),
each as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from w),
kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from each anti join gone using (doc_id, i) group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(kept.n, 0))::bigint as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from w left join kept using (doc_id)"""


#: CRC-32 in SQL: the table of its byte steps, and the sum of a list of bytes by it.
CRC_TABLE = """(select list(c order by i) as t from (
  select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c
  from (select unnest(range(0, 256)) as i)))"""


def _crc(values: str) -> str:
    return f"xor(4294967295, list_reduce(list_concat([4294967295::bigint], {values}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"


def _tree_sql(name: str, nodes: str) -> str:
    """Nodes of all levels over ``nodes`` (tree, i, digest, n), and of each node what stands to its left and right in its run."""
    return f"""
{name}(tree, lev, i, digest, n) as (
  select tree, 0, i, digest, n from {nodes}
  union all
  select tree, lev + 1, i // 3, sha256(string_agg(digest, '' order by i)), (n + 2) // 3 from {name} where n > 1 group by tree, lev, i // 3, n),
{name}_beside as (
  select a.tree, a.lev, a.i, coalesce(string_agg(b.digest, '' order by b.i) filter (b.i < a.i), '') as l, coalesce(string_agg(b.digest, '' order by b.i) filter (b.i > a.i), '') as r
  from {name} a join {name} b on a.tree = b.tree and a.lev = b.lev and a.i // 3 = b.i // 3 where a.n > 1 group by a.tree, a.lev, a.i)"""


def _op12_sql() -> str:
    field = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end"  # noqa: E731
    leaf = lambda text: f"sha256({field('doc_id')} || {field('source')} || {field('lang')} || {field('n_chars')} || {field(text)})"  # noqa: E731
    digits = "list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::bigint)"
    return f"""
with recursive t as {CRC_TABLE},
d as (select *, case when {_crc(digits)} % 2 = 0 then replace(text, chr(10), '') else text end as cropped from documents, t),
h as (select doc_id, coalesce('=' || source, '') as tree, {leaf('text')} as digest, {leaf('cropped')} as tampered from d),
leaves as (select *, row_number() over (partition by tree order by doc_id nulls first, digest) - 1 as i, count(*) over (partition by tree) as n from h),
{_tree_sql('a', 'leaves')},
subs as (select '' as tree, tree as name, digest, row_number() over (order by tree) - 1 as i, count(*) over () as n from a where n = 1),
{_tree_sql('b', 'subs')},
f(doc_id, tree, i, lev, acc, seen, own) as (
  select doc_id, tree, i, 0, tampered, '', i from leaves
  union all
  select f.doc_id, f.tree, f.i // 3, f.lev + 1, sha256(s.l || f.acc || s.r), f.seen || s.l || s.r, f.own
  from f join a_beside s on s.tree = f.tree and s.lev = f.lev and s.i = f.i),
low as (select doc_id, tree, own, arg_max(acc, lev) as acc, arg_max(seen, lev) as seen from f group by all),
g(doc_id, tree, i, lev, acc, seen, own) as (
  select doc_id, low.tree, subs.i, 0, acc, seen, own from low join subs on subs.name = low.tree
  union all
  select g.doc_id, g.tree, g.i // 3, g.lev + 1, sha256(s.l || g.acc || s.r), g.seen || s.l || s.r, g.own
  from g join b_beside s on s.lev = g.lev and s.i = g.i),
high as (select tree, own, arg_max(acc, lev) as acc, arg_max(seen, lev) as seen from g group by all)
select leaves.doc_id, leaves.digest as leaf, subs.digest as subroot, top.digest as root, sha256(high.seen) as proof_sha256, high.acc as folded_root, high.acc = top.digest as verified
from leaves join high on high.tree = leaves.tree and high.own = leaves.i join subs on subs.name = leaves.tree, (select digest from b where n = 1) top"""


def _op11_sql() -> str:
    prime, places, kept = syncmers.PRIME, syncmers.PLACES, syncmers.KEPT
    digits = "list_transform(range(octet_length(encode(u))), lambda j: (instr('123456789ABCDEF', x[2 * j + 1]) * 16 + instr('123456789ABCDEF', x[2 * j + 2]))::bigint)"
    mask, low = 1 << places, (1 << places) - 1

    def like(name: str, a: str, b: str) -> str:
        """Likeness of sketches ``a`` and ``b``, sets of rows (doc_id, h, p)."""
        return f"""
{name}_both as (select a.doc_id, a.h, a.p - b.p as d from {a} a join {b} b on a.doc_id = b.doc_id and a.h = b.h),
{name}_all as (select doc_id, h, p from {a} union all select doc_id, h, p from {b}),
{name}_some as (select doc_id, h from (select *, row_number() over (partition by doc_id order by h) as r from (select distinct doc_id, h from {name}_all)) where r <= {kept}),
{name}_span as (select doc_id, greatest({syncmers.LEAST}, max(p) // {syncmers.PART}) as span from {name}_all group by doc_id),
{name}_middle as (select doc_id, d as middle from (select *, row_number() over (partition by doc_id order by d) as r, count(*) over (partition by doc_id) as k from {name}_both) where r = (k - 1) // 2 + 1),
{name}_good as (select doc_id, h from {name}_both join {name}_span using (doc_id) join {name}_middle using (doc_id) where abs(d - middle) <= span),
{name} as (
  select doc_id, 2 * (good::double / seen) / (1 + good::double / seen) as near
  from (select s.doc_id, count(*) as seen, count(g.h) as good from {name}_some s left join {name}_good g on g.doc_id = s.doc_id and g.h = s.h group by s.doc_id))"""

    return rf"""
with t as {CRC_TABLE},
o as (select doc_id, coalesce(text, '') as text, length(coalesce(text, ''))::bigint as n, coalesce(lead(doc_id) over (order by doc_id), min(doc_id) over ()) as next from documents),
e as (select o.doc_id, o.text, o.n, o.next, left(o.text, o.n - o.n // 4) || left(b.text, o.n // 4) as edited from o join o b on b.doc_id = o.next),
x as (select doc_id, 'own' as kind, text as txt from e union all select doc_id, 'edited', edited from e),
u as (select doc_id, kind, unnest(us) as u, generate_subscripts(us, 1) - 1 as i, len(us) as k from (select doc_id, kind, regexp_extract_all(txt, '[^ 	-]{{1,4}}') as us from x)),
c as (select u, {_crc(digits)} as h from (select u, hex(encode(u)) as x from (select distinct u from u)), t),
h as (select doc_id, kind, i, k, h from u join c using (u)),
g as (select doc_id, kind, i, k, (h * 48271 + lead(h) over w * 69621 + 11) % {prime} as g from h window w as (partition by doc_id, kind order by i)),
r as (
  select doc_id, kind, i, (g * 16807 + g2 * 39373 + g3 * 62089 + 7) % {prime} as a, least(g, g3) <= least(g1, g2) as edge, bool_or(least(g, g3) <= least(g1, g2)) over (partition by doc_id, kind) as any_edge
  from (select *, lead(g, 1) over w as g1, lead(g, 2) over w as g2, lead(g, 3) over w as g3 from g window w as (partition by doc_id, kind order by i)) where i <= k - 5),
short as (select doc_id, kind, 0 as i, list_reduce(list_concat([1::bigint], list(h order by i)), lambda acc, v: (acc * 48271 + v * 69621 + 11) % {prime}) as a from h where k < 5 group by doc_id, kind),
anchors as (select doc_id, kind, i, a from r where edge or not any_edge union all select * from short),
s as (
  select doc_id, kind, h, p from (select *, row_number() over (partition by doc_id, kind order by h) as n from (select doc_id, kind, a as h, least(min(i), {low}) as p from anchors group by all))
  where n <= {kept}),
own as (select doc_id, h, p from s where kind = 'own'), edited as (select doc_id, h, p from s where kind = 'edited'),
next as (select o.doc_id, own.h, own.p from o join own on own.doc_id = o.next),{like("ne", "own", "edited")},{like("nn", "own", "next")},
f as (select doc_id, kind, string_agg(lower(printf('%08x%05x', h::bigint, p::bigint)), '' order by h) as f from s group by doc_id, kind)
select e.doc_id, e.n as n_chars, sha256(e.edited) as edited_sha256, coalesce(a.f, '') as fingerprint, coalesce(b.f, '') as edited_fingerprint,
  coalesce(ne.near, 1.0) as near_edited, coalesce(nn.near, 1.0) as near_next
from e left join f a on a.doc_id = e.doc_id and a.kind = 'own' left join f b on b.doc_id = e.doc_id and b.kind = 'edited'
  left join ne on ne.doc_id = e.doc_id left join nn on nn.doc_id = e.doc_id"""


def _op13_sql() -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
    # Of the letters beyond ASCII, UTF-8 has 195 and the code point less 64.
    octets = "flatten(list_transform(string_split(doc_id::varchar || ':' || run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195, unicode(x)::bigint - 64] end))"
    cut = lambda w, i: f"left({w}, ({i})::bigint) || substr({w}, ({i})::bigint + 2)"  # noqa: E731
    return rf"""
with recursive t as {CRC_TABLE},
r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), {letters}) as run from documents),
c as (select run, {_crc(octets)} as h from r, t),
v as (select case when h % 97 = 0 then {cut('run', 'h % length(run)')} else run end as word from c),
w as (select word, count(*) as n from v where length(word) >= 5 group by word having count(*) >= 3),
d as (select word, n, i, {cut('word', 'i')} as less from (select *, unnest(range(0, length(word))) as i from w)),
p as (
  select a.word, b.word as other, b.n from d a join d b on a.less = b.less and a.i = b.i and a.word <> b.word
  union select d.word, w.word, w.n from d join w on d.less = w.word
  union select w.word, d.word, d.n from d join w on d.less = w.word),
q as (select word, count(*) as n_near, min({{'less': -n, 'word': other}}) as best from p group by word),
f as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when -best.less >= 2 * w.n then best.word end as form, case when -best.less >= 2 * w.n then -best.less end as form_n
  from w left join q using (word)),
chain(word, now, k) as (select word, word, 0 from f union all select chain.word, f.form, k + 1 from chain join f on f.word = chain.now where f.form is not null)
select word, form, (select arg_max(now, k) from chain where chain.word = f.word) as root, n, n_near, form_n from f"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op2_line_dedup": _op2_sql(), "op3_chat_formatting": _op3_sql(), "op5_substring_dedup": _op5_sql(), "op11_document_fingerprints": _op11_sql(), "op12_merkle_manifest": _op12_sql(), "op13_spelling_variants": _op13_sql()}
