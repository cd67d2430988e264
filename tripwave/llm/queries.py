"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tripwave.llm import alignment, bpe, jaccard, language, mixing, neighbours, packing, phrases, pii, quality, secrets, sharding, urls
from tripwave.sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def _count_kind(spans, kind: str):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def _span_digest(spans, kinds: list[str] | None = None):
    """Lowercase hex of ``kind:start:end`` of the spans of ``kinds``, comma-joined."""
    chosen = spans if kinds is None else F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query("op1_language_id")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    found = language.identify_documents(read_table(spark, folder, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


URL_RULES = (urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"),
             urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/"))

URL_SQL = r"""
with recursive page as (
  select page_id, url, html, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) as host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
addressed as (
  select *, case when host <> '' then host || path || regexp_extract(url, '(?s)^[^?#]*([?][^#]*)', 1) end as address from page),
raw as (
  select address, host, path, replace(link, '&amp;', '&') as link from (
    select address, host, path, unnest(list_concat(
      list_transform(regexp_extract_all(html, '(?is)<link\s[^>]*rel\s*=\s*["'']?canonical[^>]*>'),
        lambda t: regexp_extract(t, '(?is)\shref\s*=\s*["'']?([^"''\s>]+)', 1)),
      list_transform(list_transform(regexp_extract_all(html, '(?is)<meta\s[^>]*http-equiv\s*=\s*["'']?refresh[^>]*>'),
        lambda t: regexp_extract(t, {content}, 1) || regexp_extract(t, {content}, 2) || regexp_extract(t, {content}, 3)),
        lambda c: trim(regexp_extract(c, {target}, 1) || regexp_extract(c, {target}, 2) || regexp_extract(c, {target}, 3),
          ' ' || chr(9) || chr(10) || chr(12) || chr(13))))) as link
    from addressed where url is not null and html is not null) where link <> ''),
absolute as (
  select address, case when regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') then link
    when starts_with(link, '//') then 'x:' || link when starts_with(link, '/') then 'x://' || host || link
    when starts_with(link, '#') then null when starts_with(link, '?') then 'x://' || host || path || link
    else 'x://' || host || case when path like '%/%' then regexp_extract(path, '(?s)^(.*/)', 1) else '/' end || link end as url
  from raw where link <> ''),
edge as (
  select address, lower(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)) || regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1)
    || regexp_extract(url, '(?s)^[^?#]*([?][^#]*)', 1) as target
  from absolute where regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1) <> ''),
way as (select address as a, target as b from edge where address <> target
  union select target, address from edge where address <> target),
reach as (select a, a as b from way union select reach.a, way.b from reach join way on reach.b = way.a),
rules(verdict, host, path) as (values ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
bad as (
  select distinct a from (select a, split_part(split_part(b, '?', 1), '/', 1) as host,
    substr(split_part(b, '?', 1), length(split_part(split_part(b, '?', 1), '/', 1)) + 1) as path from reach) n
  where (select max_by(r.verdict, length(r.host || r.path)) from rules r
    where ends_with('.' || n.host, '.' || r.host) and starts_with(n.path, r.path)) = 'block'),
hit as (
  select *, (select max_by(r.host || r.path, length(r.host || r.path)) from rules r
    where ends_with('.' || p.host, '.' || r.host) and starts_with(p.path, r.path)) as rule from addressed p)
select page_id, hit.host, hit.path, rule, coalesce(rules.verdict, case when bad.a is not null then 'block' end, 'allow') as verdict
from hit left join rules on rule = rules.host || rules.path left join bad on bad.a = address"""
URL_SQL = URL_SQL.replace("{content}", r"""'(?is)["''\s/]content\s*=\s*(?:"([^">]*)|''([^''>]*)|([^"''\s>][^\s>]*))'""").replace(
    "{target}", r"""'(?is)url\s*=\s*(?:"([^"]*)|''([^'']*)|([^"''\s].*))'""")


@query("op2_url_filters", URL_SQL)
def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(read_table(spark, folder, "pages"), URL_RULES)


def _count_base(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == pii.KINDS.index(kind))).cast("long").alias(f"n_{kind}")


@query("op3_pii")
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.find(read_table(spark, folder, "documents"))
    return found.select("doc_id", *[_count_base(k) for k in pii.KINDS], F.sha2(pii.digest(F.col("base")), 256).alias("base_sha256"),
                        pii.digest(F.concat("base", "added")).alias("spans"))


SHARD_DRAW = "-ln(((('0x' || substr(md5(md5(coalesce(doc_id::varchar, '')) || '/{child}'), 1, 13))::bigint)::double + 0.5) / 4503599627370496.0) / {weight}"


def _sharding_sql(shards: int = 16) -> str:
    """The tree's levels as lists of draws; the place of the smallest is the child."""

    def pick(children: list[tuple[str, float]]) -> str:
        draws = ", ".join(SHARD_DRAW.format(child=c, weight=float(w)) for c, w in children)
        return f"list_position([{draws}], list_min([{draws}]))"

    def leaf(regions: int) -> str:
        cases = []
        for g in range(regions):
            rack = pick([(f"rack r{2 * g}", 2), (f"rack r{2 * g + 1}", 2)])
            within = " ".join(f"when {k + 1} then {2 * (2 * g + k)} - 1 + {pick([(f'shard {2 * (2 * g + k) + j}', 1) for j in range(2)])}"
                              for k in range(2))
            cases.append(f"when {g + 1} then case {rack} {within} end")
        return " ".join(cases)

    regions = [(f"region g{g}", 4) for g in range(shards // 4)]
    grown = [*regions, (f"region new{shards}", 1)]
    return f"""
    with crc as (
      select list_transform(range(256), lambda b: list_reduce(range(8), lambda c, k:
        case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, b)) as t),
    placed as (
      select doc_id, strlen(coalesce(text, '')) + 1 as size, 'key' as law,
        xor(list_reduce(list_transform(range(1, strlen(coalesce(text, '')) + 1),
            lambda i: ('0x' || hex(encode(coalesce(text, ''))[i:i]))::bigint),
          lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) as text_crc32,
        case {pick(regions)} {leaf(len(regions))} end as shard,
        case {pick(grown)} {leaf(len(regions))} when {len(grown)} then {shards} end as grown_shard
      from documents, crc)
    select doc_id, size, text_crc32, law, shard::int as shard,
      row_number() over (partition by shard order by doc_id) - 1 as slot, grown_shard::int as grown_shard from placed"""


@query("op4_sharding", _sharding_sql())
def sharding_query(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.shard_documents(read_table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


@query("op5_quality_rules")
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(read_table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         "kept", "zstd_ratio")


@query("op6_secret_scans")
def secret_scans(spark: SparkSession, folder: str) -> DataFrame:
    spans = F.col("spans")
    base = ["assign", "access", "hex"]
    return secrets.scan(read_table(spark, folder, "documents")).select(
        "doc_id", *[_count_kind(spans, k) for k in base],
        F.sha2(_span_digest(spans, base), 256).alias("base_sha256"), _span_digest(spans).alias("spans"))


MIXING_SQL = r"""
with sized as (
  select doc_id, coalesce('0' || source, '1') as name, md5('mix:' || coalesce(doc_id::varchar, '')) as key,
    coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
sources as (
  select name, sum(size)::bigint as source_size,
    list_extract([5.0, 2.0, 1.0]::double[], ((row_number() over (order by name) - 1) % 3 + 1)::int) as weight from sized group by name),
ordered as (
  select *, 2.0::double * source_size as cap, row_number() over (order by source_size / weight, name) as place from sources),
levels as (
  select *, (1.5::double * (select sum(source_size) from sources)
      - coalesce(sum(cap) over (order by place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by place rows between current row and unbounded following) as level from ordered),
goal as (
  select name, source_size, case when cap < lam * weight then cap else lam * weight end as target
  from levels, (select coalesce(min_by(level, place) filter (where cap >= level * weight), 0) as lam from levels)),
budgets as (
  select *, case when source_size > 0 then floor(floor(target + 0.5) / source_size) else 0 end::bigint as epochs,
    floor(target + 0.5)::bigint as budget from goal),
tied as (
  select name, key, sum(size) as s, count(*) as n, sum(sum(size)) over (partition by name order by key) as upto
  from sized group by name, key)
select doc_id, size, source_size, target,
  (epochs * size + case when upto <= budget - epochs * source_size then size
    when upto - s >= budget - epochs * source_size then 0
    else least(size, floor((budget - epochs * source_size - upto + s) / n)) end)::bigint as taken
from sized join budgets using (name) join tied using (name, key)"""


@query("op7_mixing", MIXING_SQL)
def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_words(read_table(spark, folder, "documents"))


JACCARD_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') as w from documents),
shingled as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as s from worded),
token as (select doc_id, unnest(s) as t from shingled),
pair as (
  select a.doc_id as a, b.doc_id as b, count(*) as common from token a join token b on a.t = b.t and a.doc_id <> b.doc_id
  group by all),
link as (
  select a, b from pair join shingled x on x.doc_id = a join shingled y on y.doc_id = b
  where 100 * common >= 85 * (len(x.s) + len(y.s) - common)),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, link.b from reach join link on reach.b = link.a)
select doc_id, len(s) as n_shingles, (select min(b) from reach where a = doc_id) as component_id from shingled"""


@query("op8_jaccard_join", JACCARD_SQL)
def jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.similar_groups(read_table(spark, folder, "documents"))


@query("op9_nearest_neighbours")
def nearest_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_table(spark, folder, "embeddings")
    return neighbours.search(vectors, vectors.where("vec_id % 50 = 0"), 5)


@query("op10_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    encoded = bpe.encode(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                         public_tokenizers.PATTERN)
    return bpe.digests(encoded)


PHRASE_SQL = r"""
with piece as (
  select coalesce(lang, 'und') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')),
    '[^\x20\x09]+') as w from documents),
total as (select lang, sum(len(w))::hugeint as n from piece group by lang),
gram as (
  select lang, unnest(flatten(list_transform(range(1, 6), lambda k:
    list_transform(range(1, len(w) - k + 2), lambda i: w[i:i + k - 1])))) as g from piece),
freq as (select lang, g, count(*) as f from gram group by all having f >= 100),
inner_part as (
  select lang, f, unnest(flatten(list_transform(range(2, len(g)), lambda m:
    list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) as g from freq),
cover as (select lang, g, max(f) as f from inner_part group by all),
alone as (
  select freq.lang, freq.g, freq.f from freq left join cover using (lang, g)
  where len(freq.g) >= 2 and (cover.f is null or 100 * cover.f < 100 * freq.f)),
cut as (select lang, g, f, unnest(range(1, len(g))) as c from alone),
scored as (
  select cut.lang, array_to_string(cut.g, ' ') as phrase, cut.f as a, x.f as l, y.f as r, n, c,
    (1000::hugeint * cut.f * n) // (x.f::hugeint * y.f) as score
  from cut join freq x on x.lang = cut.lang and x.g = cut.g[1:c] join freq y on y.lang = cut.lang and y.g = cut.g[c + 1:]
    join total on total.lang = cut.lang),
worst as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
  n::bigint as n, score::bigint as score
from worst qualify row_number() over (partition by lang order by score desc, a desc, phrase) <= 2000"""


@query("op11_phrase_mining", PHRASE_SQL)
def phrase_mining(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(read_table(spark, folder, "documents"))


@query("op12_token_alignment")
def token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return alignment.align_documents(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                     public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN)


@query("op13_packing")
def packing_query(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack_documents(read_table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                    public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
