"""Pages cut into blocks; navigation, adverts and what a site repeats are told by links, words and counts over all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.tables import by_keys, cut_lineage

# Parts of a page that are never text, and elements that begin or end a block.
_HIDDEN = r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>"
_BLOCKS = r"(?i)</?(?:p|div|article|section|nav|header|footer|aside|main|ul|ol|li|table|tr|td|th|h[1-6]|body|html|form|blockquote|pre|br)\b[^>]*>"
_ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def page_blocks(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page, host, place, text, words, link_share) of each block with words; ``link_share`` is its share of characters within links."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, " ")
    rows = pages.select(F.col(page_id).alias("page"), F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)).alias("host"), F.posexplode(F.split(bare, _BLOCKS)).alias("place", "raw"))

    def plain(c):
        out = F.regexp_replace(c, "<[^>]*>", " ")
        for sign, text in _ENTITIES:
            out = F.replace(out, F.lit(sign), F.lit(text))
        return F.trim(F.regexp_replace(out, r"\s+", " "))

    linked = F.array_join(F.regexp_extract_all("raw", F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), " ")
    out = rows.select("page", "host", "place", plain(F.col("raw")).alias("text"), plain(linked).alias("linked")).where("text <> ''")
    return out.select("page", "host", "place", "text", F.size(F.split("text", " ")).alias("words"), F.least(F.lit(1.0), F.length("linked") / F.length("text")).alias("link_share"))


def clean_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", most_links: float = 0.5, least_words: int = 3, most_pages: int = 3) -> DataFrame:
    """(page, kept, dropped, text) of each page: the blocks that are its own text, joined by newlines.

    A block goes if over ``most_links`` of its characters are links, if it has
    under ``least_words`` words, or if its text is on ``most_pages`` pages or
    more of its host.  Counts run over all pages; a text is known by its
    digest there, and digests that many blocks have meet them by broadcast.  Null pages have no blocks, and rows of one id are one page.
    """
    blocks = page_blocks(pages, page_id, url, html).withColumn("digest", F.md5(F.concat("host", F.lit("\n"), "text")))
    blocks = cut_lineage(blocks)
    on = blocks.select("digest", "page").distinct().groupBy("digest").agg(F.count("*").alias("pages"))
    times = blocks.groupBy("digest").agg(F.count("*").alias("times")).join(on, "digest").where(F.col("pages") >= most_pages)
    repeated = cut_lineage(times.select("digest", "times"))
    able = blocks.where((F.col("link_share") <= most_links) & (F.col("words") >= least_words))
    own = by_keys(able, repeated, {"digest": F.col("digest")}, "times", blocks.count(), False)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n")  # no more than a page holds
    kept = own.groupBy("page").agg(F.count("*").alias("kept"), text.alias("text"))
    every = pages.select(F.col(page_id).alias("page")).distinct().withColumn("blocks", F.lit(0).cast("long"))
    sizes = every.unionByName(blocks.groupBy("page").agg(F.count("*").alias("blocks"))).groupBy("page").agg(F.sum("blocks").alias("blocks"))
    found = sizes.join(kept.withColumnRenamed("page", "of"), F.col("page").eqNullSafe(F.col("of")), "left")
    n = F.coalesce("kept", F.lit(0))
    return found.select(F.col("page").alias(page_id), n.alias("kept"), (F.col("blocks") - n).alias("dropped"), F.coalesce("text", F.lit("")).alias("text"))
