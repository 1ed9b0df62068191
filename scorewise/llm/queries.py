"""The registered queries: each applies one operator, with its production settings, to its whole table."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewise.session import configure

from . import bpe, decontaminate, exact, html_text, language, manifest, mixing, near, phrases, quality, repeats, templates, tokens

Query = Callable[[SparkSession, str], DataFrame]
ARROW_ROWS = 2_000  # texts handed to Python at once
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tokens.revisions().alias("edits"))
    return tokens.edited(tokens.built(docs), whole=False)


@query("op2_mix_sources", """
with sized as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents
), sources as (
  select source, cast(sum(size) as bigint) as source_size, row_number() over (order by source asc nulls last) as place
  from sized group by source
), weighted as (
  select *, case (place - 1) % 3 when 0 then 5 when 1 then 2 else 1 end as weight from sources
), filled as (
  select *,
    sum(source_size) over () - coalesce(3 * sum(source_size) over (
      order by source_size / weight, place rows between unbounded preceding and 1 preceding), 0) as still_left,
    sum(weight) over (order by source_size / weight, place rows between current row and unbounded following) as among
  from weighted
), marked as (
  select *, 3 * source_size * among <= weight * still_left as stopped,
    row_number() over (partition by 3 * source_size * among <= weight * still_left order by source_size / weight, place) as nth
  from filled
), level as (
  select still_left as level_left, among as level_among from marked where not stopped and nth = 1
), targets as (
  select source, source_size,
    case when stopped then cast(3 * source_size as double)
         else cast(weight * level_left as double) / level_among end as target
  from marked left join level on true
), coins as (
  select s.doc_id, s.size, t.source_size, t.target,
    case when t.source_size = 0 then 0.0 else t.target / t.source_size end as rate,
    cast(cast(concat('0x', substr(md5(concat('0:', coalesce(cast(s.doc_id as varchar), ''))), 1, 13)) as bigint) as double)
      / 4503599627370496.0 as coin
  from sized s join targets t on s.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  cast(size * (floor(rate) + case when coin < rate - floor(rate) then 1 else 0 end) as bigint) as taken
from coins
""")
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.with_copies(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    size = mixing.n_words()
    return mix.select("doc_id", size.alias("size"), "source_size", "target", (size * F.col("copies")).alias("taken"))


@query("op3_substring_dedup")
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.without_repeats(docs, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").cast("long").alias("n_passages"))


@query("op4_language_id")
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", language.held_out().alias("held_out"), "text")
    return language.predicted(rows, language.fit(docs), keep=["doc_id", "held_out"])


@query("op5_line_templates", """
with lined as (
  select doc_id, no, line from (
    select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line,
      unnest(range(len(string_split(coalesce(text, ''), chr(10))))) as no from documents)
), cut as (
  select doc_id, no, line,
    list_transform(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tokens
  from lined
), leafed as (
  select *, concat_ws(' ', len(tokens), array_to_string(list_slice(tokens, 1, 4), ' ')) as leaf from cut where len(tokens) > 0
), leaves as (
  select leaf from leafed group by leaf having count(distinct coalesce(cast(doc_id as varchar), '')) >= 5
), candidates as (
  select * from leafed where leaf in (select leaf from leaves)
), counted as (
  select leaf, line, any_value(tokens) as tokens, count(distinct coalesce(cast(doc_id as varchar), '')) as docs
  from candidates group by leaf, line
), placed as (
  select leaf, line, docs, unnest(tokens) as token, unnest(range(len(tokens))) as place from counted
), support as (
  select leaf, place, token from placed where token <> '<*>' group by leaf, place, token having sum(docs) >= 5
), formed as (
  select p.leaf, p.line, string_agg(coalesce(s.token, '<*>'), ' ' order by p.place) as template, count(s.token) as fixed, count(*) as size
  from placed p left join support s on p.leaf = s.leaf and p.place = s.place and p.token = s.token group by p.leaf, p.line
), constant as (
  select * from formed where fixed >= 0.6 * size
), templates as (
  select c.leaf, f.template from candidates c join constant f on c.leaf = f.leaf and c.line = f.line
  group by c.leaf, f.template having count(distinct coalesce(cast(c.doc_id as varchar), '')) >= 5
), dropped as (
  select distinct f.leaf, f.line from constant f join templates t on f.leaf = t.leaf and f.template = t.template
), kept as (
  select l.doc_id, l.no, l.line, d.line is not null as gone
  from cut l left join dropped d
    on d.line = l.line and d.leaf = concat_ws(' ', len(l.tokens), array_to_string(list_slice(l.tokens, 1, 4), ' '))
)
select doc_id, cast(case when count(*) = 1 and max(line) = '' then 0 else count(*) end as bigint) as n_lines,
  cast(count(*) filter (where gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by no) filter (where not gone), '')) as kept_sha256
from kept group by doc_id
""")
def op5_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = templates.without_recurring_lines(docs)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query("op6_html_text")
def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return html_text.extracted(pages, html_text.fit(pages), keep=["page_id", "url"])


@query("op7_exact_dedup", """
with normal as (
  select doc_id, length(coalesce(text, '')) as chars, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') as bare
  from documents
), ranked as (
  select doc_id, bare, first_value(doc_id) over (partition by bare order by chars desc, doc_id) as keep_id,
    count(*) over (partition by bare) as group_size, row_number() over (partition by bare order by chars desc, doc_id) as nth
  from normal
)
select doc_id, keep_id, cast(group_size as bigint) as group_size, nth = 1 as kept, sha256(bare) as text_sha256 from ranked
""")
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicate_groups(table(spark, sf_dir, "documents"))


@query("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(table(spark, sf_dir, "documents"))


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.select("doc_id", quality.held_out().alias("held_out"), "text")
    return quality.scored(rows, quality.fit(docs, labels), keep=["doc_id", "held_out"])


@query("op10_decontaminate")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.summary(found)


@query("op11_collocations", """
with pieces as (
  select coalesce(lang, 'und') as lang, row_number() over () as doc,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') as parts
  from documents
), cut as (
  select lang, doc, unnest(range(len(parts))) as piece, unnest(parts) as part from pieces
), worded as (
  select lang, doc, piece, regexp_extract_all(part, '[^\x20\x09]+') as words from cut
), totals as (
  select lang, sum(len(words)) as n from worded group by lang
), starts as (
  select lang, doc, piece, unnest(words) as w, unnest(range(len(words))) as i from worded
), following as (
  select lang, w, lead(w, 1) over p as w2, lead(w, 2) over p as w3, lead(w, 3) over p as w4
  from starts window p as (partition by doc, piece order by i)
), counted as (
  select lang, w as phrase, count(*) as f from following group by all
  union all select lang, concat_ws(' ', w, w2), count(*) from following where w2 is not null group by all
  union all select lang, concat_ws(' ', w, w2, w3), count(*) from following where w3 is not null group by all
  union all select lang, concat_ws(' ', w, w2, w3, w4), count(*) from following where w4 is not null group by all
), frequent as materialized (
  select lang, phrase, cast(f as hugeint) as f, string_split(phrase, ' ') as words, len(string_split(phrase, ' ')) as k from counted where f >= 30
), split as (
  select lang, phrase, f, words, k, unnest(range(1, k)) as j from frequent
), headed as (
  select *, array_to_string(words[1 : j], ' ') as head, array_to_string(words[j + 1 : k], ' ') as tail from split
), cuts as (
  select c.lang, c.phrase, c.k, c.f, c.j, h.f as l, t.f as r, 2000000 * c.f // (h.f + t.f) as score
  from headed c join frequent h on h.lang = c.lang and h.phrase = c.head join frequent t on t.lang = c.lang and t.phrase = c.tail
), worst as (
  select * from cuts qualify row_number() over (partition by lang, phrase, k order by score, j) = 1
), around as (
  select c.lang, array_to_string(c.words[o.o + 1 : o.o + s.s], ' ') as phrase, s.s as k, max(c.f) as f
  from frequent c, (select unnest(range(0, 3)) as o) o, (select unnest(range(2, 4)) as s) s
  where s.s < c.k and o.o + s.s <= c.k group by all
), kept as (
  select w.* from worst w left join around a on a.lang = w.lang and a.phrase = w.phrase and a.k = w.k
  where a.f is null or 100 * a.f < 80 * w.f
), ranked as (
  select *, row_number() over (partition by lang order by score desc, f desc, encode(phrase)) as rank from kept
)
select k.lang, cast(rank as bigint) as rank, phrase, cast(k.f as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r,
  cast(t.n as bigint) as n, cast(score as bigint) as score
from ranked k join totals t on t.lang = k.lang where rank <= 2000
""")
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


@query("op13_byte_bpe")
def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded(table(spark, sf_dir, "documents"), keep=["doc_id"], whole=False)


_CRC32 = """xor(4294967295, list_reduce(
  list_transform(range(len(cast(doc_id as varchar))), lambda i: cast(ascii(cast(doc_id as varchar)[i + 1]) as bigint)),
  lambda c, b: list_reduce(range(8), lambda d, bit: xor(d >> 1, 3988292384 * (d & 1)), xor(c, b)), cast(4294967295 as bigint)))"""
_MERKLE = """
with recursive hashed as (
  select doc_id, source, crc32, sha256(concat(a, t)) as leaf,
    sha256(concat(a, case when crc32 % 2 = 0 then replace_entry else t end)) as candidate
  from (
    select doc_id, source, concat(
        coalesce(concat(len(cast(doc_id as varchar)), ':', cast(doc_id as varchar)), '-'),
        coalesce(concat(strlen(source), ':', source), '-'), coalesce(concat(strlen(lang), ':', lang), '-'),
        coalesce(concat(len(cast(n_chars as varchar)), ':', cast(n_chars as varchar)), '-')) as a,
      coalesce(concat(strlen(text), ':', text), '-') as t,
      coalesce(concat(strlen(replace(text, chr(10), '')), ':', replace(text, chr(10), '')), '-') as replace_entry,
      {crc} as crc32
    from documents)
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place from hashed
), levels as (
  select source, 0 as depth, list(leaf order by place) as nodes from placed group by source
  union all
  select source, depth + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  from levels where len(nodes) > 1
), subroots as (
  select source, nodes[1] as subroot, row_number() over (order by source nulls first) - 1 as place from levels where len(nodes) = 1
), tops as (
  select 0 as depth, list(subroot order by place) as nodes from subroots
  union all
  select depth + 1, list_transform(range((len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  from tops where len(nodes) > 1
), steps as (
  select p.doc_id, p.source, p.leaf, p.place, l.depth, l.nodes, p.place // cast(pow(3, l.depth) as bigint) as i, len(l.nodes) as n
  from placed p join levels l on p.source is not distinct from l.source where len(l.nodes) > 1
  union all
  select p.doc_id, p.source, p.leaf, p.place, 1000 + t.depth, t.nodes, s.place // cast(pow(3, t.depth) as bigint), len(t.nodes)
  from placed p join subroots s on p.source is not distinct from s.source, tops t where len(t.nodes) > 1
), sided as (
  select doc_id, source, leaf, place, depth,
    array_to_string(list_slice(nodes, i - i % 3 + 1, i), '') as before,
    array_to_string(list_slice(nodes, i + 2, least(i - i % 3 + 3, n)), '') as behind
  from steps
), ways as (
  select source, place, list({{'a': before, 'z': behind}} order by depth) as way, string_agg(before || behind, '' order by depth) as proof
  from sided group by source, place
), folded as (
  select p.source, p.place, p.candidate as node, 0 as done, w.way from placed p left join ways w on p.place = w.place and p.source is not distinct from w.source
  union all
  select source, place, sha256(concat(way[done + 1].a, node, way[done + 1].z)), done + 1, way from folded where done < coalesce(len(way), 0)
)
select p.doc_id, p.leaf, s.subroot, t.nodes[1] as root, sha256(coalesce(w.proof, '')) as proof_sha256, f.node as folded_root,
  f.node = t.nodes[1] as verified
from placed p join subroots s on p.source is not distinct from s.source
join (select nodes from tops where len(nodes) = 1) t on true
left join ways w on w.place = p.place and w.source is not distinct from p.source
join folded f on f.place = p.place and f.source is not distinct from p.source and f.done = coalesce(len(w.way), 0)
"""


@query("op12_manifest", _MERKLE.format(crc=_CRC32))
def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = manifest.leaf(text=manifest.without_line_feeds())
    return manifest.verified(manifest.manifest(docs, candidate=tampered))
