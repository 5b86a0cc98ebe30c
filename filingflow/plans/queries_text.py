"""Registered text queries: HTML cleaning, length filter, chunking, concatenation."""

from __future__ import annotations

from pyspark.sql import functions as F

from filingflow.functions import text as T
from filingflow.operators import chunking
from filingflow.operators.parallel import by_setting
from filingflow.plans.catalog import register
from filingflow.sources.tables import read_table

# DuckDB spelling of the same cleaning steps (RE2 has no back-references, so
# each dropped block is its own pass, in the same order as the Spark side).
_SQL_STRIP = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?s)<!--.*?-->', ' ', 'g'),
      '(?is)<script\\b[^>]*>.*?</script\\s*>', ' ', 'g'),
      '(?is)<style\\b[^>]*>.*?</style\\s*>', ' ', 'g'),
      '(?is)<noscript\\b[^>]*>.*?</noscript\\s*>', ' ', 'g'),
      '(?is)<(?:script|style|noscript)\\b[^>]*>.*$', ' ', 'g'),
      '<[A-Za-z/!?][^>]*>', ' ', 'g')"""


def _sql_unescape_once(x: str) -> str:
    # the entities present in the pages; HTML5 also decodes the legacy "&amp"
    # written without its semicolon (truncated pages end that way)
    for ent, ch in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&"), ("&amp", "&")):
        x = f"replace({x}, '{ent}', '{ch}')"
    return x


_SQL_TEXT = f"trim(regexp_replace({_sql_unescape_once(_sql_unescape_once(_SQL_STRIP))}, '\\s+', ' ', 'g'))"

_SQL_TOKENS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"


# Markup that no pattern gets right, and its text; a page's own html follows.
_HOSTILE = [
    ("""<p title="a > b">hello</p>""", "hello"),
    ("""<a href='x>y' data-q = "1 > 0" it's>link</a>""", "link"),
    ("""<script>if (a < b && c > d) { x = "</p>"; }</SCRIPT >after<style>p > b {}</style>""", "after"),
    ("""<noscript><img alt="</noscript>"><noscript>x</noscript>no</noscript>yes<script src="a>b"/>""", "yes"),
    ("""<!-- <p>not</p> > --><br title='"'/>a < b &amp;lt; c""", "a < b < c"),
]
_SQL_HOSTILE = "[" + ", ".join(f"'{t}'" for _, t in _HOSTILE) + f"][page_id % {len(_HOSTILE)} + 1]"


@register("html_text", "SC-6 SC-7 SC-10 SC-11 SRC-6", oracle=f"""
select page_id, case when html is not null then trim({_SQL_HOSTILE} || ' ' || {_SQL_TEXT}) end as text from pages
""")
def html_text(spark, d):
    pages = by_setting(read_table(spark, d, "pages", "page_id", "html"), ["page_id"])
    hostile = F.array(*(F.lit(h) for h, _ in _HOSTILE))[(F.col("page_id") % len(_HOSTILE)).cast("int")]
    return T.add_clean_text(pages.withColumn("html", F.concat(hostile, F.lit(" "), "html")), "html").select("page_id", "text")


@register("min_words", "FLT-6 SC-12", oracle="""
select doc_id, n_words from (
  select doc_id, cast(len(regexp_extract_all(text, '\\S+')) as bigint) as n_words from documents)
where n_words >= 500
""")
def min_words(spark, d):
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    return (docs.select("doc_id", T.word_count("text").cast("bigint").alias("n_words"))
            .where(F.col("n_words") >= 500))


@register("word_chunks", "SC-13 WN-5 WN-6", oracle=f"""
with t as (select doc_id, {_SQL_TOKENS} as tok from documents),
s as (select doc_id, tok, unnest(range(0, greatest(1, len(tok) - 200), 600)) as st
      from t where len(tok) > 0)
select doc_id, cast(st // 600 as bigint) as chunk_index,
       cast(len(list_slice(tok, st + 1, st + 800)) as bigint) as n_tokens,
       array_to_string(list_slice(tok, st + 1, st + 800), ' ') as chunk_text
from s
""")
def word_chunks(spark, d):
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    ch = chunking.chunk_text(docs, "text", ["doc_id"])
    return ch.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"),
                     F.col("n_tokens").cast("bigint").alias("n_tokens"), "chunk_text")


# Pieces are words with the white space behind them, so joined pieces are the text.
_WS = r" \t\n\x0B\f\r"


@register("chunk_spans", "SC-13 WN-5 WN-6", oracle=rf"""
with t as (select doc_id, regexp_extract_all(text, '[^{_WS}]+[{_WS}]*') as p,
                  len(regexp_extract(text, '^[{_WS}]*')) as lead from documents),
s as (select *, unnest(range(0, greatest(1, len(p) - 200), 600)) as st from t where len(p) > 0),
w as (select doc_id, st, len(list_slice(p, st + 1, st + 800)) as n_tokens,
             lead + len(array_to_string(list_slice(p, 1, st), '')) as char_start,
             regexp_replace(array_to_string(list_slice(p, st + 1, st + 800), ''), '[{_WS}]+$', '') as chunk_text from s)
select doc_id, cast(st // 600 as int) as chunk_index, cast(st as int) as first_token, cast(n_tokens as int) as n_tokens,
       cast(char_start as int) as char_start, cast(char_start + len(chunk_text) as int) as char_end, chunk_text
from w
""")
def chunk_spans(spark, d):
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    return chunking.chunk_spans(docs, "text", ["doc_id"])


@register("chunk_counts", "AG-5 WN-5", oracle=f"""
select doc_id,
       cast(case when n > 0 then 1 + ceil(greatest(0, n - 800) / 600.0) else 0 end as bigint) as n_chunks
from (select doc_id, len({_SQL_TOKENS}) as n from documents)
""")
def chunk_counts(spark, d):
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    out = chunking.chunk_counts(docs, "text", ["doc_id"])
    return out.select("doc_id", F.col("n_chunks").cast("bigint").alias("n_chunks"))


# Every third page gets a style attribute, every fourth a mention of the item, so that both outcomes occur.
def _styled(pages):
    mark = F.lit('<p class="a" style="color: red">x</p><i STYLE=bold>y</i>')
    return F.when(F.col("page_id") % 3 == 0, F.concat(mark, "html")).otherwise(F.col("html"))


@register("style_strip", "SC-8", oracle=f"""
select page_id, case when page_id % 3 = 0 then '<p class="a">x</p><i>y</i>' || rest else rest end as html
from (select page_id, regexp_replace(html, '(?i)(<[^>]*?)\\sstyle\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', '\\1', 'g') as rest from pages)
""")
def style_strip(spark, d):
    pages = read_table(spark, d, "pages", "page_id", "html")
    return pages.select("page_id", T.strip_style_attributes(_styled(pages)).alias("html"))


@register("item507_scan", "FLT-5 SC-6 SC-7", oracle=f"""
select page_id, page_id % 4 = 0 or coalesce(regexp_matches({_SQL_TEXT}, '(?i)\\bITEM\\s*5\\.07\\b'), false) as mentions_item_507
from pages
""")
def item507_scan(spark, d):
    pages = by_setting(read_table(spark, d, "pages", "page_id", "html"), ["page_id"])
    # a mention across tags and lines, and near misses that aren't one
    mention = F.when(F.col("page_id") % 4 == 0, F.lit("<p>see <b>Item</b>\n5.07.</p>")).otherwise(F.lit("<p>Items 5.075, item 5x07</p>"))
    pages = pages.select("page_id", F.concat(mention, F.coalesce("html", F.lit(""))).alias("html"))
    return T.add_clean_text(pages, "html").select("page_id", T.mentions_item_507("text").alias("mentions_item_507"))


# Characters of Windows-1252 by byte; the five bytes without one become replacement characters.
_SQL_1252 = "[" + ", ".join(f"chr({ord(bytes([b]).decode('windows-1252', errors='replace'))})" for b in range(256)) + "]"


# Bytes no UTF-8 text holds stand before a page's own, so the whole page takes the fallback.
@register("decode_html_bytes", "SC-9", oracle=f"""
select page_id, html as text, 'caf' || chr(233) || ' ' || chr(8364) || ' ' || page_id || ' ' || coalesce(array_to_string(list_transform(
         regexp_extract_all(hex(encode(html)), '..'), lambda x: {_SQL_1252}[cast('0x' || x as int) + 1]), ''), '') as text_1252
from pages
""")
def decode_html_bytes(spark, d):
    pages = read_table(spark, d, "pages", "page_id", "html")
    own = F.encode("html", "UTF-8")
    old = F.concat(F.unhex(F.lit("636166E9208020")), F.encode(F.concat(F.col("page_id").cast("string"), F.lit(" ")), "UTF-8"),
                   F.coalesce(own, F.lit(b"")))
    return pages.select("page_id", T.decode_bytes(own).alias("text"), T.decode_bytes(old).alias("text_1252"))


@register("decode_page_bytes", "SC-9", oracle="""
select page_id, 'utf-8' as variant, html as text from pages
union all
select page_id, 'windows-1252', 'caf' || chr(233) || ' ' || chr(8364) || ' ' || page_id from pages
""")
def decode_page_bytes(spark, d):
    pages = read_table(spark, d, "pages", "page_id", "html")
    # every page's own text, and as further rows bytes that are not valid UTF-8
    old = F.concat(F.unhex(F.lit("636166E9208020")), F.encode(F.col("page_id").cast("string"), "UTF-8"))
    both = F.array(F.struct(F.lit("utf-8").alias("variant"), F.encode("html", "UTF-8").alias("data")),
                   F.struct(F.lit("windows-1252").alias("variant"), old.alias("data")))
    rows = pages.select("page_id", F.inline(both))
    return rows.select("page_id", "variant", T.decode_bytes("data").alias("text"))


@register("chunk_json_export", "SNK-3 WN-5 SC-15", oracle=f"""
with t as (select doc_id, {_SQL_TOKENS} as tok from documents),
s as (select doc_id, tok, unnest(range(0, greatest(1, len(tok) - 200), 600)) as st
      from t where len(tok) > 0)
select doc_id, cast(to_json(list({{'chunk_index': cast(st // 600 as integer),
                                   'chunk_text': array_to_string(list_slice(tok, st + 1, st + 800), ' ')}}
                                  order by st)) as varchar) as json
from s group by doc_id
""")
def chunk_json_export(spark, d):
    from filingflow.sources import handoff
    docs = by_setting(read_table(spark, d, "documents", "doc_id", "text"), ["doc_id"])
    ch = chunking.chunk_text(docs, "text", ["doc_id"])
    return handoff.chunks_as_json(ch, "doc_id", with_embedding=False)
