"""Queries of the operators with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, exact_dedup, fingerprints, language_id, line_dedup, lm_scoring, mixing, near_dedup, sentencepiece_codec, sharding, source_divergence, token_counts, toxicity

WORD = r"[^\x20\x09-\x0D]+"


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_docs(spark, sf_dir), k=3, percent=85)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(_docs(spark, sf_dir))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score_texts(_docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op5_mixing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_blocks(_docs(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.drop_boilerplate(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode(_docs(spark, sf_dir), tokenizer("piece_bpe_32k.model"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(_docs(spark, sf_dir))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_docs(spark, sf_dir), 16)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_docs(spark, sf_dir))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = toxicity.remainder("doc_id", 3)
    return language_id.languages(_docs(spark, sf_dir), rest != 1, F.coalesce(rest == 1, F.lit(False)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = conversation_repair.repair(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return found.withColumn("repaired_sha256", conversation_repair.repaired_sha256("repaired")).drop("repaired")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}


def _permuted_sql(x: str, n: str, seed: str, back: bool = False) -> str:
    """mixing.permuted, or place_of with back."""
    a, b, c, p, half = mixing.A, mixing.B, mixing.C, mixing.PRIME, mixing.HALF
    high = f"((r * {a} + {seed} * {b} + 12345) % {p} * {c} % {p})"
    other = f"((({high} * {half} + ({high} * {a} + r) % {p}) % {n} - v + {n}) % {n})"
    low = f"((greatest(v, {other}) % {half} % {p} * {a} + (greatest(v, {other}) >> 31) * {b} + r * {b} + {seed} * {c}) % {p})"
    rounds = f"range({mixing.ROUNDS}, 0, -1)" if back else f"range(1, {mixing.ROUNDS + 1})"
    return f"list_reduce({rounds}, lambda v, r: case when ({low} * {a} % {p} * {b} % {p} // 1024) % 2 = 1 then {other} else v end, {x})"


def _mixed_sql() -> str:
    """Sources (t to j), the draw of shards (g to c), laid-out documents (l) and their blocks (b)."""
    block, shard = mixing.BLOCK, mixing.SHARD
    return rf"""
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as bigint) as size from documents),
t as (select source, sum(size)::bigint as ss from d group by 1),
o as (select *, row_number() over (order by source nulls last) - 1 as number from t),
w as (select *, number % 3 + 1 as weight, 3 * ss as cap from o),
p as (select *, sum(cap) over u as cb, sum(weight) over u as wb, sum(ss) over () as al, sum(weight) over () as wl from w
      window u as (order by cap / weight, number rows between unbounded preceding and 1 preceding)),
f as (select *, cap * (wl - coalesce(wb, 0)) <= (al - coalesce(cb, 0)) * weight as ful from p),
e as (select *, case when ful then cap::double else (al - coalesce(sum(cap) filter (where ful) over (), 0)) * weight / (sum(weight) filter (where not ful) over ())::double end as target from f),
h as (select number::bigint as number, source, ss, coalesce(target, 0) as target, (ss + {block - 1}) // {block} as blocks,
      case when ss > 0 then cast(floor(target / ss) as bigint) else 0 end as whole from e),
i as (select *, case when ss > 0 then least(cast(round(target - whole * ss) as bigint), ss) else 0 end as rest, ss - (blocks - 1) * {block} as short,
      {_permuted_sql("blocks - 1", "greatest(blocks, 1)", "(number + 1)", back=True)} as pos from h),
n as (select *, rest + case when ss > 0 and (pos < rest // {block} or (pos = rest // {block} and rest % {block} >= short)) then {block} - short else 0 end as need from i),
m as (select *, need % {block} as part, whole * blocks + need // {block} + (need % {block} > 0)::bigint as slots from n),
j as (select *, coalesce(sum(slots) over (order by number rows between unbounded preceding and 1 preceding), 0)::bigint as before, (sum(slots) over ())::bigint as total from m),
g as (select number, total, before + unnest(range(slots)) as g from j),
x as (select number, {_permuted_sql("g", "total", "0")} // {shard} as shard, total from g),
y as (select number, shard, any_value(total) as total, count(*) as n from x group by 1, 2),
z as (select *, coalesce(sum(n) over (partition by number order by shard rows between unbounded preceding and 1 preceding), 0)::bigint as q0,
      coalesce(sum(n) over (partition by shard order by number rows between unbounded preceding and 1 preceding), 0)::bigint as at0, least({shard}, total - shard * {shard}) as places from y),
q as (select z.*, unnest(range(n)) as k from z),
c as (select number, shard, {_permuted_sql("at0 + k", "places", "(shard + 1)")} as slot, {_permuted_sql("(q0 + k) % blocks", "blocks", "(number + 1)")} as block,
      case when q0 + k = slots - 1 and part > 0 then part else {block} end as words from q join j using (number)),
l as (select doc_id, source, size, number, ss, target, coalesce(sum(size) over (partition by number order by xor(mixed, mixed >> 11) % (select greatest({mixing.PARTS}, count(*) // {mixing.PART_ROWS}) from documents), doc_id
      rows between unbounded preceding and 1 preceding), 0)::bigint as first from (select *, xor(once, once >> 13) * {mixing.B} % {mixing.PRIME} as mixed from (select *, (coalesce(doc_id, size) % {mixing.PRIME} + {mixing.PRIME}) % {mixing.PRIME} * {mixing.A} % {mixing.PRIME} as once from d)) join (select number, source as s, ss, target from j) on source is not distinct from s),
b as (select *, unnest(range(first // {block}, (first + size - 1) // {block} + 1)) as block from l where size > 0)"""


def _breakable_sql() -> str:
    steps = []
    for i, (opener, closer) in enumerate(line_dedup.PARTS.items()):
        head = f"regexp_extract(t, '(?is)^.*{closer}')"
        steps.append(f"v{i + 1} as (select page_id, url, {head} || regexp_replace(t[len({head}) + 1:], '(?i)<({opener})', '<' || chr(65535) || '\\1', 'g') as t from v{i}),")
    return "\n".join(steps)


def _repair_sql() -> str:
    """A fold over turns as a recursion: e, s, u, a are (cost, audit) after nothing, system, user, assistant."""

    def edit(state: str, cost: str | int, initial: str) -> str:
        return f"struct_pack(c := {state}.c + {cost}, a := {state}.a || '{initial}')"

    def reached(state: str, initial: str, before: str) -> str:
        ways = [edit(state, 2, "D")]
        for b in before:
            ways.append(f"case when free and i = '{initial}' then {edit(b, 'extra', 'K')} end")
            if initial != "s":
                ways.append(f"case when free then {edit(b, 'extra + 1', 'R')} end")
        return f"list_min([{', '.join(ways)}])"

    inserted = f"list_min([u, {edit('e', 5, 'I')}, {edit('s', 5, 'I')}, {edit('a', 5, 'I')}])"
    closed = f"(select c, pos, e, s, u, list_min([a, {edit('u', 5, 'I')}]) as a from (select c, pos, e, s, {inserted} as u, a from r))"
    never = "struct_pack(c := 1000000000000::bigint, a := '')"
    return rf"""
with recursive z as (select list_transform(range(256), lambda i: list_reduce(range(8), lambda v, k: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, i)) as t),
d as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, xor(list_reduce(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''),
  lambda x: ascii(x)::bigint), lambda v, b: xor(v >> 8, t[xor(v & 255, b) + 1]), 4294967295), 4294967295) % 20 as draw from conversations, z),
m as (select conv_id, turn, case when draw = 4 then 'user' else role end as role, case draw when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
  unnest(range(case draw when 3 then 2 else 1 end)) as copy from d where draw <> 0),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos from m),
f as (select *, left(role, 1) as i, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'b' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'd'
  when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 't' else '' end as fault, lag(left(role, 1)) over (partition by conv_id order by pos) || left(role, 1) as pair from p),
g as (select conv_id, row_number() over () as c from (select distinct conv_id from conversations)),
x as (select c, f.*, fault in ('', 't') as free, case when fault = 't' then 5 else 0 end as extra from f join g on f.conv_id is not distinct from g.conv_id),
r as (select c, 0::bigint as pos, struct_pack(c := 0::bigint, a := '') as e, {never} as s, {never} as u, {never} as a from g
  union all select k.c, x.pos, {edit('e', 2, 'D')}, {reached('s', 's', 'e')}, {reached('u', 'u', 'esa')}, {reached('a', 'a', 'u')} from {closed} k join x on x.c = k.c and x.pos = k.pos + 1),
b as (select c, arg_max(list_min([e, a]), pos) as best from {closed} group by 1),
n as (select c, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (where fault = 'b') as blank, count(*) filter (where fault = 'd') as duplicate,
  count(*) filter (where fault = 't') as truncated, count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal from x group by 1),
s as (select c, k - 1 as k, segs[k] as seg from (select c, unnest(range(1, len(segs) + 1)) as k, segs from (select c, regexp_extract_all(best.a, 'I*[DKR]|I+$') as segs from b))),
o as (select c, k, e, j, row_number() over (partition by c order by k, j) - 1 as place from (select c, k, unnest(es) as e, unnest(range(len(es))) as j from (select c, k, regexp_extract_all(seg, '[IKR]') as es from s))),
l as (select o.*, x.role, x.text, max(case when place = 0 and e = 'K' and i = 's' then 1 else 0 end) over (partition by o.c) as led from o left join x on x.c = o.c and x.pos = o.k + 1),
w as (select c, string_agg(case when e = 'K' then role when (place - led) % 2 = 0 then 'user' else 'assistant' end || ':' || case when e = 'I' then '' else text end, chr(10) order by place) as t from l group by 1)
select conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, best.c as cost, best.a as audit, sha256(coalesce(t, '')) as repaired_sha256 from g join b using (c) left join n using (c) left join w using (c)"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def oracle_sql() -> dict[str, str]:
    op1 = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{WORD}') as ws from documents),
s as (
  select doc_id, case when len(ws) >= 3 then list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))
                      when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as sh from w),
n as (select doc_id, cast(len(sh) as bigint) as n_shingles from s),
e as (select doc_id, unnest(sh) as x from s),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.x = b.x and a.doc_id < b.doc_id group by 1, 2),
l as (select i.a, i.b from i join n p on p.doc_id = i.a join n q on q.doc_id = i.b where 100 * i.c >= 85 * (p.n_shingles + q.n_shingles - i.c)),
g as (select a, b from l union all select b, a from l),
r as (select doc_id as a, doc_id as root from n union select g.b, r.root from r join g on g.a = r.a),
m as (select a as doc_id, min(root) as component_id from r group by 1)
select n.doc_id, n_shingles, component_id, n.doc_id = component_id as kept from n join m using (doc_id)"""
    op9 = r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from t window w as (partition by norm)"""
    mixed = _mixed_sql()
    op5 = mixed + f""",
k as (select l.doc_id, sum(greatest(least(first + size, block * {mixing.BLOCK} + words) - greatest(first, block * {mixing.BLOCK}), 0)) as taken from b l join c using (number, block) group by 1)
select doc_id, size, ss as source_size, target, coalesce(taken, 0)::bigint as taken from l left join k using (doc_id)"""
    op5_blocks = mixed + f""",
k as (select shard, slot, source, block, doc_id, greatest(first, block * {mixing.BLOCK}) - first as "at", least(first + size, block * {mixing.BLOCK} + words) - greatest(first, block * {mixing.BLOCK}) as n from b l join c using (number, block))
select * from k where n > 0"""
    op7 = rf"""
with v0 as (select page_id, url, replace(coalesce(html, ''), chr(65535), '') as t from pages),
{_breakable_sql()}
v4 as (select page_id, url, replace(regexp_replace(t, '{line_dedup.HIDDEN}', chr(10), 'g'), chr(65535), '') as t from v3),
v5 as (select page_id, url, regexp_replace(left(t, len(t) - len(regexp_extract(t, '[^>]*$'))), '{line_dedup.BREAKS}', chr(10), 'g') || regexp_extract(t, '[^>]*$') as t from v4),
v6 as (select page_id, url, regexp_replace(left(t, len(t) - len(regexp_extract(t, '[^>]*$'))), '{line_dedup.TAGS}', '', 'g') || regexp_extract(t, '[^>]*$') as t from v5),
c as (select page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)?([^/:?#]+)', 2)) as host,
  list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))), lambda x: x <> '') as ls from v6),
h as (select page_id, host, unnest(list_distinct(ls)) as line from c),
t as (select host, count(*) as pages from c group by 1 having count(*) >= {line_dedup.MIN_PAGES}),
b as (select h.host, line from h join t on h.host = t.host group by h.host, line, pages having count(*) > {line_dedup.RATIO} * pages),
g as (select host, list(line) as gone from b group by 1),
s as (select page_id, c.host, ls, list_filter(ls, lambda x: not list_contains(coalesce(gone, []), x)) as st from c left join g on c.host = g.host)
select page_id, host, len(ls)::bigint as n_lines, (len(ls) - len(st))::bigint as n_dropped, array_to_string(st, chr(10)) as text from s"""
    op11 = rf"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source,
  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents),
g as (select distinct lang, source from d),
o as (select i, lang, source, unnest(w) as term from d),
k as (select lang, term from o group by 1, 2 having count(distinct i) >= {source_divergence.MIN_DOCS}),
v as (select lang, count(*) as v from k group by 1),
n as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by 1, 2, 3),
t as (select lang, source, sum(n) as t from n group by 1, 2),
c as (select g.lang, g.source, k.term, coalesce(n.n, 0) as n, coalesce(t.t, 0) as t, v.v from g join k using (lang) join v using (lang)
  left join n using (lang, source, term) left join t using (lang, source)),
p as (select *, 1 + {source_divergence.SCALE}::hugeint * (n + 5) // (t + 5 * v) as p,
  1 + {source_divergence.SCALE}::hugeint * (sum(n) over u + 5) // (sum(t) over u + 5 * v) as q from c window u as (partition by lang, term)),
a as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by 1, 2, 3),
r as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
  left join a x on x.lang = a.lang and x.source = a.source and x.item = b.source),
f as (select lang, source, 'term' as part, term as item, (p - q)::bigint as value from p where n > 0 and p > q),
s as (select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from (select * from r union all select * from f))
select * from s where part = 'pair' or rank <= {source_divergence.TOP}"""
    return {"op1_near_dedup": op1, "op5_mixing": op5, "op5_mixing_blocks": op5_blocks, "op7_line_dedup": op7, "op9_exact_dedup": op9, "op11_source_divergence": op11, "op13_conversation_repair": _repair_sql()}
