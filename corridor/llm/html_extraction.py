"""Main text of pages by a suffix array of each host's runs.

The pages of a host are one stream of tokens: a token is a text run with its place in the page, so a run of any length counts whole, and every page ends with a token
that all pages share. A suffix begins at each run; suffixes are carried as far as ``WORDS`` words and sorted by host, tokens and page, which is the host's suffix array
to that depth. Neighbours that agree to the full depth begin a substring of at least ``WORDS`` words that repeats; it is boilerplate's if it is found on distinct pages
(of another address or text). Sorted ranges are tasks of any number; a substring that fills several ranges, however common it is, is one row of each, and these meet.

A run is covered if such a substring holds it. A place (path of elements and classes) on a host is a boilerplate place if most of its different runs are covered. Covered
runs of boilerplate places go. Elsewhere those go whose neighbours differ from page to page: of four pairs of neighbours at least, and of a quarter as many as the host
has pages; a copied article keeps its neighbours, so its runs stay. Unique runs stay. What repetition can't tell is then checked by what elements say of themselves:
menus, forms, comments and the like go though unique, and where a page has an article (or else a main part), its runs stay though repeated, and others go.
``n_repeated`` and ``n_corrected`` say how many runs of a page the array marked, and on how many the check ruled otherwise.

A page without html has no text. Repeated rows get a row each and count as one page; null ids keep their rows; a page without a host shares one with all such pages. A
host of one page has no repeats. Pages are read whole, whatever their length. An empty table gives no rows. Other columns are left behind, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corridor.llm.common import drop_written, even_join, map_arrow, mark, written
from corridor.llm.html_runs import ARTICLE, NONE, OUT, level, runs, token
from corridor.llm.url_filter import host_and_path

#: A substring is long from this many words on.
WORDS = 4
#: From so many pairs of neighbours, and so many for each of the host's pages, a covered run is boilerplate wherever it stands.
SHARE, PAGES = 0.25, 4
#: Boilerplate tokens that are handed to every task (8 bytes each), counted first; beyond, they are joined by key.
FEW = 500_000
END = -1
PARSED = "host long, page long, tokens array<long>, words array<int>, places array<long>"


def pages_of(pages: DataFrame) -> DataFrame:
    """page_id, url, html, the host's and the page's hash."""
    host, _ = host_and_path(pages["url"].cast("string"))
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).alias("html"), host.alias("host"))
    return own.select("page_id", "url", "html", F.xxhash64("host").alias("host"), F.xxhash64("url", "html").alias("page"))


def parsed(own: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, int] = {}
        for b in batches:
            tokens, words, places = [], [], []
            for host, text in zip(b["host"].to_pylist(), b["html"], strict=True):
                found = runs(text.as_py())
                tokens.append([token(host, r) for r in found])
                words.append([r.text.count(" ") + 1 for r in found])
                if len(seen) > 100_000:
                    seen.clear()
                for r in found:
                    if r.place not in seen:
                        seen[r.place] = token(0, r._replace(text=""))
                places.append([seen[r.place] for r in found])
            yield pa.RecordBatch.from_arrays([b["host"], b["page"], pa.array(tokens, pa.list_(pa.int64())), pa.array(words, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int64()))], ["host", "page", "tokens", "words", "places"])

    return map_arrow(own.select("host", "page", "html"), run, PARSED)


def depths(words: np.ndarray, pages: np.ndarray) -> np.ndarray:
    """How many tokens each suffix is carried, over all pages of a batch one after the other. pages: where each ends; the end token stands behind a page's last run."""
    n = len(words)
    before = np.concatenate([[0], np.cumsum(words)])
    reach = np.searchsorted(before, before[:-1] + WORDS)  # first place by which WORDS words are read
    ends = np.repeat(pages, np.diff(np.concatenate([[0], pages])))
    return np.minimum(reach, ends + 1) - np.arange(n)


def suffixes(units: DataFrame) -> DataFrame:
    """host, suffix (its tokens, eight bytes each), page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array(b["tokens"].value_lengths(), np.int64)
            tokens, words = b["tokens"].flatten().to_numpy(), b["words"].flatten().to_numpy()
            ends = np.cumsum(sizes)
            many = depths(words, ends)
            stream = np.insert(tokens, ends, END)  # an end token behind each page
            row = np.repeat(np.arange(len(b)), sizes)
            starts = np.arange(len(tokens)) + row
            data = stream.astype("<i8").tobytes()
            own = [data[8 * s : 8 * (s + m)] for s, m in zip(starts.tolist(), many.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b["host"].take(pa.array(row)), pa.array(own, pa.binary()), b["page"].take(pa.array(row))], ["host", "suffix", "page"])

    return map_arrow(units, run, "host long, suffix binary, page long")


def repeats(units: DataFrame) -> DataFrame:
    """host, suffix, pages: the beginnings of substrings that are on at least two pages, and on how many."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbours in the array: a row for each run of suffixes that agree to the full depth and are on two pages or at either end of the range."""
        open_, done = None, []  # host, suffix, first page, last page, pages, whether at the range's beginning
        at_start = True
        for b in batches:
            if not len(b):
                continue
            host, page, suffix = b["host"].to_numpy(), b["page"].to_numpy(), b["suffix"]
            same = np.zeros(len(b), bool)
            same[1:] = (host[1:] == host[:-1]) & np.asarray(pa.compute.equal(suffix[1:], suffix[:-1]))
            same[0] = open_ is not None and open_[0] == host[0] and open_[1] == suffix[0].as_py()
            new_page = np.r_[open_ is None or open_[3] != page[0], page[1:] != page[:-1]]
            heads = np.flatnonzero(~same)
            bounds = np.r_[heads, len(b)]
            grown = np.add.reduceat(new_page | ~same, heads) if len(heads) else np.zeros(0, np.int64)
            if same[0]:
                first = int(bounds[0])
                open_ = (*open_[:3], int(page[first - 1]), open_[4] + int(new_page[:first].sum()), open_[5])
            for k, lo in enumerate(heads):
                if open_ is not None and (open_[4] > 1 or open_[5]):
                    done.append(open_)
                open_ = (int(host[lo]), suffix[int(lo)].as_py(), int(page[lo]), int(page[bounds[k + 1] - 1]), int(grown[k]), at_start)
                at_start = False
            if len(done) > 4096:
                yield batch(done)
                done = []
        if open_ is not None:
            done.append(open_)
        if done:
            yield batch(done)

    def batch(done: list) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*done, strict=True))[:5], kinds, strict=True)], ["host", "suffix", "first", "last", "pages"])

    order = ["host", "suffix", "page"]
    array = suffixes(units).repartitionByRange(*order).sortWithinPartitions(*order)
    runs_ = map_arrow(array, scan, "host long, suffix binary, first long, last long, pages long")
    # a substring has a row in each range that holds some of it; where one range ends and the next begins within a page, that page was counted twice
    met = runs_.groupBy("host", "suffix").agg(F.sum("pages").alias("pages"), F.array_sort(F.collect_list(F.struct("first", "last"))).alias("parts"))
    twice = F.aggregate(F.sequence(F.lit(1), F.size("parts") - 1), F.lit(0).cast("long"), lambda n, k: n + F.when(F.get("parts", k)["first"] == F.get("parts", k - 1)["last"], 1).otherwise(0))
    return met.select("host", "suffix", (F.col("pages") - F.when(F.size("parts") > 1, twice).otherwise(0)).alias("pages")).where(F.col("pages") > 1)


def boilerplate(units: DataFrame) -> DataFrame:
    """token (each once): the covered runs that go."""
    found = repeats(units.select("host", "page", "tokens", "words"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.array(pa.compute.binary_length(b["suffix"]), np.int64) // 8
            tokens = np.frombuffer(b"".join(b["suffix"].to_pylist()), "<i8")
            row = pa.array(np.repeat(np.arange(len(b)), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(tokens), b["pages"].take(row)], ["token", "pages"])

    covered = written(map_arrow(found.select("suffix", "pages"), split, "token long, pages long").where(F.col("token") != END).groupBy("token").agg(F.max("pages").alias("pages")), "covered")
    hosts = units.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("of"))
    context = lambda k: F.xxhash64(F.get("tokens", k - 1), F.get("tokens", k + 1))
    each = units.select("host", F.explode(F.transform("tokens", lambda t, k: F.struct(t.alias("token"), F.get("places", k).alias("place"), context(k).alias("context")))).alias("r")).select("host", "r.*")
    each = each.groupBy("host", "token", "place").agg(F.count_distinct("context").alias("contexts"))
    each = written(each.join(covered, "token", "left"), "runs")
    places = each.groupBy("host", "place").agg((2 * F.count("pages") > F.count("*")).alias("common"), F.count("*").alias("rows"))
    marked = each.where("pages IS NOT NULL")
    marked = even_join(marked, places.select("host", "place", "common"), ["host", "place"], sizes=places)
    sizes = marked.groupBy("host").agg(F.count("*").alias("rows"))
    marked = even_join(marked, hosts, ["host"], sizes=sizes)
    often = (F.col("contexts") >= PAGES) & (F.col("contexts") >= SHARE * F.col("of"))
    return written(marked.where(F.col("common") | often).select("token").distinct(), "boilerplate")


def chosen(host: int, html: str, repeated) -> tuple[str, int, int]:
    """Text, runs that the array marked, and runs on which the check ruled otherwise. repeated: whether each of some tokens is boilerplate."""
    found = runs(html)
    if not found:
        return "", 0, 0
    out = repeated([token(host, r) for r in found])
    own = level(found)
    keep = [r.state == own if own > NONE else r.state == NONE and not gone for r, gone in zip(found, out, strict=True)]
    return " ".join(r.text for r, k in zip(found, keep, strict=True) if k), sum(map(bool, out)), sum(bool(k) == bool(gone) for k, gone in zip(keep, out, strict=True))


TEXTS = "page_id long, url string, text string, n_chars long, n_repeated int, n_corrected int"


def texts(own: DataFrame, few: np.ndarray | None) -> DataFrame:
    """few: the boilerplate tokens, sorted; None if the rows bring those of their own runs in a column ``gone``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, (host, text) in enumerate(zip(b["host"].to_pylist(), b["html"], strict=True)):
                some = few if few is not None else np.sort(np.array(b["gone"][k].as_py() or [], np.int64))
                at = lambda tokens, some=some: some[np.minimum(np.searchsorted(some, tokens), len(some) - 1)] == tokens if len(some) else [False] * len(tokens)
                rows.append(chosen(host, text.as_py(), at))
            columns = list(zip(*rows, strict=True)) if rows else [[], [], []]
            yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(columns[0], pa.string()), pa.array([len(t) for t in columns[0]], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["page_id", "url", "text", "n_chars", "n_repeated", "n_corrected"])

    return map_arrow(own, run, TEXTS)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_repeated, n_corrected of every row of page_id, url, html."""
    spark, since = pages.sparkSession, mark()
    own = pages_of(pages)
    units = written(parsed(own), "runs")
    marked = boilerplate(units)
    if marked.count() <= FEW:
        few = np.sort(np.array([r.token for r in marked.toLocalIterator()], np.int64))
        out = texts(own.select("page_id", "url", "html", "host"), few)
    else:
        at = units.select("page", F.explode("tokens").alias("token")).distinct()
        gone = written(even_join(at, marked, ["token"], "left_semi").groupBy("page").agg(F.collect_set("token").alias("gone")), "gone")  # a page's own runs at most
        out = texts(own.join(gone, "page", "left").select("page_id", "url", "html", "host", "gone"), None)
    out = written(out, "texts")
    drop_written(spark, since, out)
    return out
