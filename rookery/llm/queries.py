"""The queries ``opN_...``: each operator over its whole table, with its SQL twin
where SQL can express it. Texts, tokens and files stay columns of the operators;
the queries derive digests from them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm import (
    bpe,
    chat,
    collocations,
    html_text,
    jaccard,
    lines,
    media,
    minhash,
    mixing,
    quality,
    simhash,
    warc,
    whitening,
)
from rookery.llm.common import documents, prepared
from rookery.sources.tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            ORACLE[run.__name__] = sql
        return run

    return wrap


def vocabulary_path() -> str:
    """BPE_VOCABULARY, or the vocabulary of the installed package of public tokenizers."""
    if named := os.environ.get("BPE_VOCABULARY"):
        return named
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every text and the text decoded from them, as digests."""
    ids = F.array_join(F.col("tokens").cast("array<string>"), ",")
    return bpe.encoded(documents(spark, sf_dir), vocabulary_path()).select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query()
def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text kept as an image: digests of the payload read back and of the file."""
    tail = F.expr("substring(payload, -64, 64)")
    return media.stored(documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


_MIX_SQL = """
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as size,
         md5('0:' || coalesce(cast(doc_id as varchar), '')) as key
  from documents),
each as (
  select source, sum(size) as s, ([5, 2, 1])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as w
  from sized group by source),
-- Sources in the order in which they stop: with the first k stopped, the share of a unit of weight.
stops as (
  select source, s, w, row_number() over (order by 3.0 * s / w, source nulls last) as k,
         sum(s) over () as total,
         coalesce(sum(s) over (order by 3.0 * s / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as s_before,
         coalesce(sum(w) over (order by 3.0 * s / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as w_before,
         sum(w) over () as w_all
  from each),
share as (
  select (cast(total - 3 * s_before as bigint)::double / cast(w_all - w_before as bigint)::double) as share
  from stops
  where cast(total - 3 * s_before as double) / (w_all - w_before) * w <= 3.0 * s
  order by k limit 1),
goal as (
  select source, cast(s as bigint) as source_size, least((select share from share) * w, cast(3 * s as double)) as target
  from each),
run as (
  select d.doc_id, d.size, g.source_size, g.target,
         coalesce(sum(d.size) over (partition by d.source order by key, doc_id, size
                  rows between unbounded preceding and 1 preceding), 0) as start,
         floor(g.target)::bigint as budget
  from sized d join goal g on d.source is not distinct from g.source),
cut as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from run)
select doc_id, cast(size as bigint) as size, source_size, target,
       cast(epochs * size + greatest(0, least(size, budget - epochs * source_size - start)) as bigint) as taken
from cut
"""


@query(_MIX_SQL)
def op4_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed by source: words taken of each."""
    return mixing.mixed(read(prepared(spark), sf_dir, "documents")).drop("copies")


_CHAT_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, len(regexp_extract_all(role || chr(0) || text,
    '<\\*\|im_start\|>|<\\*\|im_sep\|>|<\\*\|im_end\|>|<\\*\|endoftext\|>|<\\*s>|<\\*/s>|\[\\*INST\]|\[\\*/INST\]')) as marks
  from turns),
whole as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn, role nulls first, text nulls first) as lines,
    coalesce(string_agg(text, '' order by turn, role nulls first, text nulls first) filter (where role = 'assistant'), '') as loss,
    sum(length(role) + length(text) + marks + 12 + 10 + 10 + 1) as formatted_chars
  from marked group by conv_id)
select conv_id, n_turns, sha256(lines) as turns_sha256, length(loss) as loss_chars,
  sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars
from whole
"""


@query(_CHAT_SQL)
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one made of control strings, formatted and read back."""
    given = read(prepared(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(
        F.inline(
            F.array(
                *(
                    F.struct(
                        F.lit(-7).cast("long").alias("conv_id"),
                        F.lit(k).cast("long").alias("turn"),
                        F.lit(role).alias("role"),
                        F.lit(control).alias("text"),
                    )
                    for k, role in enumerate(("user", "assistant"))
                )
            )
        )
    )
    return chat.read_turns(chat.formatted(given.unionByName(more))).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(chat.turn_lines(), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query("""
with sized as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest
  from pages),
firsts as (select digest, min(page_id) as first_id from sized where n >= 100 group by digest)
select page_id, n as payload_bytes, digest as payload_digest,
  case when first_id is null or first_id = page_id then 'response' else 'revisit' end as record_type,
  case when first_id <> page_id then first_id end as refers_to
from sized left join firsts using (digest)
""")
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page converted from ARC, written as WARC and read back."""
    return warc.archived(read(prepared(spark), sf_dir, "pages"))


@query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, of their edited texts, and how alike they are."""
    return simhash.edited_fingerprints(documents(spark, sf_dir))


_JACCARD_SQL = r"""
with recursive worded as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
shingled as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
    else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end) as s
  from worded),
sets as (select doc_id, count(*) as n, md5(string_agg(s, chr(10) order by s)) as k from shingled group by doc_id),
reps as (select k, min(doc_id) as rep, any_value(n) as n from sets group by k),
small as (select rep, n, s from shingled join reps on doc_id = rep),
rare as (select s from small group by s having count(*) > 1),
counted as (
  select a.rep as a, b.rep as b, a.n as m, b.n as n, count(*) as common
  from (select * from small semi join rare using (s)) a
  join (select * from small semi join rare using (s)) b
    on a.s = b.s and a.rep < b.rep and 100 * a.n >= 85 * b.n and 100 * b.n >= 85 * a.n
  group by all),
links as (select a, b from counted where 100 * common >= 85 * (m + n - common)),
edges as (select a, b from links union select b, a from links),
reach(node, other) as (
  select rep, rep from reps
  union
  select reach.node, edges.b from reach join edges on reach.other = edges.a),
named as (select node, min(other) as component_id from reach group by node)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(c.component_id, d.doc_id) as component_id
from documents d left join sets s using (doc_id) left join reps r on s.k = r.k left join named c on r.rep = c.node
"""


# The same components for shingles of five words, and whether a document names its own.
_MINHASH_SQL = (
    _JACCARD_SQL.replace("len(w) < 4", "len(w) < 5")
    .replace("range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3]", "range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4]")
    .replace("as component_id\nfrom documents d", "as component_id,\n  coalesce(c.component_id, d.doc_id) is not distinct from d.doc_id as kept\nfrom documents d")
)


@query(_MINHASH_SQL)
def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates by shingles of five words, and which documents stay."""
    return minhash.deduplicated(documents(spark, sf_dir))


@query(_JACCARD_SQL)
def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under Jaccard similarity of four-word shingles."""
    return jaccard.similar(documents(spark, sf_dir), 4, 85)


_LINES_SQL = r"""
with split as (
  select doc_id, md5(text) as hash, unnest(string_split(text, chr(10))) as line,
    unnest(range(len(string_split(text, chr(10))))) as line_no
  from documents),
single as (
  select *, trim(regexp_replace(line, '[ \t]+', ' ', 'g'), ' ') as s from split),
masked as (
  select doc_id, hash, line_no, s, case when regexp_matches(line, '[0-9]')
    then regexp_replace(s, '\S*[0-9]\S*', '<*>', 'g') else s end as masked
  from single),
counted as (
  select *, string_split(masked, ' ') as t, len(string_split(masked, ' ')) as tokens,
    len(string_split(masked, ' ')) - (length(padded) - length(replace(padded, ' <*> ', ''))) // 5 as fixed
  from (select *, ' ' || replace(masked, ' ', '  ') || ' ' as padded from masked)),
lines as (
  select *, case when contains(masked, '<*>') and fixed < 0.7 * tokens then s else masked end as line,
    case when tokens >= 6 and not (contains(masked, '<*>') and fixed < 0.7 * tokens)
      then array_to_string(t[1:3], ' ') end as lead
  from counted where masked <> ''),
each as (
  select line, lead, tokens, any_value(t) as t, min(doc_id) as first_id, min(hash) as low, max(hash) as high
  from lines group by line, lead, tokens),
leaves as (
  select lead, tokens, count(*) as n_lines from each where lead is not null
  group by all having count(*) > 1 and min(low) < max(high)),
placed as (
  select lead, tokens, line, first_id, low, high, n_lines, unnest(t) as token, unnest(range(len(t))) as place
  from each join leaves using (lead, tokens)),
common as (
  select lead, tokens, place, token from placed where token <> '<*>'
  group by all having min(low) < max(high) and 100 * count(*) > 5 * max(n_lines)),
known as (
  select placed.*, common.place is not null as constant
  from placed left join common using (lead, tokens, place, token)),
templates as (
  select lead, tokens, line, min(first_id) as first_id, min(low) as low, max(high) as high,
    string_agg(case when constant then token else '<*>' end, ' ' order by place) as template
  from known group by lead, tokens, line having count(*) filter (where constant) >= 0.7 * tokens),
shared as (
  select lead, tokens, template, min(first_id) as first_id
  from templates group by all having min(low) < max(high)),
recurring as (
  select r.line, r.first_id, md5(d.text) as first_hash from (
    select line, min(first_id) as first_id from (
      select line, first_id from each where low < high
      union all
      select t.line, s.first_id from templates t join shared s using (lead, tokens, template))
    group by line) r join documents d on r.first_id = d.doc_id),
judged as (
  select s.doc_id, s.line_no, s.line, l.line is not null as filled, coalesce(s.hash <> r.first_hash, false) as dropped
  from split s left join lines l on s.doc_id = l.doc_id and s.line_no = l.line_no
  left join recurring r on l.line = r.line),
rest as (
  select doc_id, count(*) filter (where filled) as n_lines, count(*) filter (where dropped) as n_dropped,
    coalesce(string_agg(line, chr(10) order by line_no) filter (where not dropped), '') as text
  from judged group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped, sha256(c.text) as text_sha256
from documents d left join rest c using (doc_id)
"""


@query(_LINES_SQL)
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat an earlier document's template."""
    cleaned = lines.kept_lines(read(prepared(spark), sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query()
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents from two co-trained views."""
    docs = read(prepared(spark), sf_dir, "documents")
    return quality.scored(docs, quality.trained(docs, read(spark, sf_dir, "labels")))


@query()
def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = read(prepared(spark), sf_dir, "pages")
    found = html_text.extracted(pages, html_text.trained(pages))
    return found.withColumn("n_chars", F.length("text").cast("long"))


_PHRASES_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
worded as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
grams as (
  select lang, unnest(w) as phrase from worded
  union all
  select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from worded
  union all
  select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
  from worded),
counts as materialized (select lang, phrase, count(*) as f from grams group by lang, phrase),
totals as (select lang, sum(len(w)) as n from worded group by lang),
cands as (
  select lang, phrase, f as a, string_split(phrase, ' ') as w from counts
  where f >= 10 and contains(phrase, ' ')),
cuts as (
  select lang, phrase, a, w, unnest(range(1, len(w))) as k from cands),
parts as materialized (
  select lang, phrase, a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:len(w)], ' ') as y
  from cuts),
scored as (
  select p.lang, p.phrase, a, k, l.f as l, r.f as r, (1000000::hugeint * a * a) // (l.f::hugeint * r.f) as score
  from parts p
  join counts l on l.lang = p.lang and l.phrase = p.x
  join counts r on r.lang = p.lang and r.phrase = p.y),
best as (
  select * from (
    select *, row_number() over (partition by lang, phrase order by score, k) as place from scored)
  where place = 1),
inside as (
  select lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) as phrase
  from cands where len(w) = 3),
dropped as (
  select distinct i.lang, i.phrase from inside i
  join cands c on c.lang = i.lang and c.phrase = i.phrase and 100 * i.a >= 50 * c.a),
ranked as (
  select b.*, row_number() over (partition by lang order by score desc, a desc, phrase) as rank
  from best b anti join dropped using (lang, phrase))
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score
from ranked join totals using (lang) where rank <= 2000
"""


@query(_PHRASES_SQL)
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 best collocations of every language."""
    return collocations.mined(read(prepared(spark), sf_dir, "documents"))


@query()
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings projected on their four leading components, to unit variance."""
    return whitening.whitened(read(prepared(spark), sf_dir, "embeddings")).drop("deviation_exact")
