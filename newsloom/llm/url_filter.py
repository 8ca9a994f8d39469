"""URL filters: a sorted digest array, memory-mapped and probed with vectorised binary search.

An entry is ``host`` + ``path`` (``spam.example/``, ``org/news/``). It fits a url whose host is that host or a subdomain
of it and whose path starts with that path. Entries are kept as sorted 64-bit xxhash digests plus their full strings.
A url's possible entries are its host suffixes joined with its path cut at every path length in use; the digests of all
of them in a batch are searched at once, and each hit is confirmed against the stored string, so colliding digests
never decide. The longest fitting entry wins (of equal lengths the one with the longer host).

Explicit rules win over the list. A list of at most ``PART_BYTES`` is one array that travels with the tasks and is probed
in a narrow pass. A larger list never passes the driver: the distinct possible entries of the crawl meet the list part by
part (a hash cuts both into parts of about that size), each task maps and probes its own part's array, and the
longest hit of each distinct host and path start in use is joined back to the urls. Both ways give the same rows.

Defined cases: a null url or one without ``://`` has an empty host and path and fits nothing, which allows it; entries
that are null or empty are ignored; repeated entries count once (block before allow); rows and null ids are kept; empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.arrow import small_batches, written

PART_BYTES = 32 << 20
# Words in a host's labels that put it on the list built from a crawl.
BLOCK_WORDS = ("adult", "bets", "casino", "porn", "spam", "xxx")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def build(entries: list[tuple[str, str]]) -> bytes:
    """``(entry, verdict)`` pairs as one array: counts, path lengths in use, sorted digests, offsets, verdicts, strings."""
    best: dict[str, str] = {}
    for entry, verdict in entries:
        if entry:
            best[entry] = max(verdict, best.get(entry, ""))
    rows = sorted((xxhash.xxh64_intdigest(e.encode()), e.encode(), v) for e, v in best.items())
    ends = np.cumsum([0, *(len(e) for _, e, _ in rows)])
    paths = sorted({len(e) - e.find("/") if "/" in e else 0 for e in best})     # in characters
    return (struct.pack("<qq", len(rows), len(paths)) + np.array(paths, "<u8").tobytes()
            + np.array([d for d, _, _ in rows], "<u8").tobytes() + ends.astype("<u8").tobytes() + bytes(v == "block" for _, _, v in rows) + b"".join(e for _, e, _ in rows))


class DigestArray:
    """A built array, mapped from an unnamed file of the worker."""

    def __init__(self, data: bytes):
        self.file = tempfile.TemporaryFile()
        self.file.write(data)
        self.file.flush()
        n, n_paths = struct.unpack("<qq", data[:16])
        view = np.memmap(self.file, np.uint8, "r")[16:]
        self.path_lengths = view[:8 * n_paths].view("<u8").tolist()
        view = view[8 * n_paths:]
        self.digests = view[:8 * n].view("<u8")
        self.ends = view[8 * n:8 + 16 * n].view("<u8")
        self.block = view[8 + 16 * n:8 + 17 * n]
        self.strings = view[8 + 17 * n:]

    def entry(self, i: int) -> str:
        return self.strings[int(self.ends[i]):int(self.ends[i + 1])].tobytes().decode()

    def find(self, keys: list[str]) -> np.ndarray:
        """Index of each key in the array, or -1."""
        out = np.full(len(keys), -1)
        if not len(self.digests) or not keys:
            return out
        wanted = np.array([xxhash.xxh64_intdigest(k.encode()) for k in keys], np.uint64)
        lo = np.searchsorted(self.digests, wanted, "left")
        hi = np.searchsorted(self.digests, wanted, "right")
        for k in np.flatnonzero(hi > lo):       # confirm the full string; digests may collide
            for i in range(int(lo[k]), int(hi[k])):
                if self.entry(i) == keys[k]:
                    out[k] = i
        return out

    def longest(self, hosts: list[str], paths: list[str]) -> list[tuple[str, str] | None]:
        """The longest fitting entry and its verdict per url."""
        keys: list[str] = []
        owner: list[tuple[int, int]] = []
        for u, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            at = 0
            while host and at >= 0:
                suffix = host[at:]
                for n in self.path_lengths:
                    if n <= len(path):
                        keys.append(suffix + path[:n])
                        owner.append((u, len(suffix)))
                at = host.find(".", at) + 1 or -1
        best: list[tuple[int, int, str, str] | None] = [None] * len(hosts)
        found = self.find(keys)
        for k in np.flatnonzero(found >= 0):
            u, host_len = owner[k]
            hit = (len(keys[k]), host_len, keys[k], "block" if self.block[found[k]] else "allow")
            if best[u] is None or hit > best[u]:
                best[u] = hit
        return [b and (b[2], b[3]) for b in best]


def _probe(rows: DataFrame, data: bytes, entry: str, verdict: str) -> DataFrame:
    """One narrow pass: sets ``entry`` and ``verdict`` to the longest hit in one array."""
    names = rows.columns
    at = {n: names.index(n) for n in ("host", "path", entry, verdict)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray(data)
        for batch in batches:
            hits = array.longest(batch.column(at["host"]).to_pylist(), batch.column(at["path"]).to_pylist())
            columns = list(batch.columns)
            columns[at[entry]] = pa.array([h and h[0] for h in hits], pa.string())
            columns[at[verdict]] = pa.array([h and h[1] for h in hits], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, rows.schema)


def _pairs(table: pa.Table) -> list[tuple[str, str]]:
    return list(zip(table["entry"].to_pylist(), table["verdict"].to_pylist(), strict=True))


def _probe_parts(rows: DataFrame, table: DataFrame, list_bytes: int, part_bytes: int) -> DataFrame:
    """``rows`` with ``listed`` and ``list_verdict`` from a list of any size; see the module's text."""
    slash = F.instr("entry", "/")
    in_use = table.select(F.when(slash > 0, F.length("entry") - slash + 1).otherwise(0).alias("n")).distinct()
    lengths = F.array(*[F.lit(r.n) for r in in_use.orderBy("n").collect()])
    fits = lambda path: F.filter(lengths, lambda n: n <= F.length(path))            # noqa: E731
    # all that the list can see of a path: its longest start of a length in use
    rows = rows.drop("listed", "list_verdict").withColumn(
        "cut", F.substring("path", F.lit(1), F.coalesce(F.array_max(fits("path")), F.lit(0))))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)),
                           lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    starts = F.transform(fits("cut"), lambda n: F.substring("cut", F.lit(1), n))
    keyed = (rows.where("host != ''").select("host", "cut").distinct()
             .select("host", "cut", F.explode(suffixes).alias("suffix"))
             .select("host", "cut", "suffix", F.explode(starts).alias("start"))
             .select("host", "cut", F.length("suffix").alias("host_len"), F.concat("suffix", "start").alias("key")))
    keyed = written(keyed, "url-keys")
    keys = written(keyed.select("key").distinct(), "url-distinct")
    key_bytes = keys.agg(F.sum(F.octet_length("key") + 17)).first()[0] or 0
    n = F.lit(-(-max(list_bytes, key_bytes) * 11 // (10 * part_bytes)) or 1)

    def run(key: tuple, asked: pa.Table, listed: pa.Table) -> pa.Table:
        array, wanted = DigestArray(build(_pairs(listed))), asked["key"].to_pylist()
        found = [(wanted[k], "block" if array.block[i] else "allow")
                 for k, i in enumerate(array.find(wanted).tolist()) if i >= 0]
        return pa.table({"key": pa.array([e for e, _ in found], pa.string()),
                         "list_verdict": pa.array([v for _, v in found], pa.string())})

    hits = (keys.groupBy(F.pmod(F.xxhash64("key"), n)).cogroup(table.groupBy(F.pmod(F.xxhash64("entry"), n)))
            .applyInArrow(run, "key string, list_verdict string"))
    best = (keyed.join(hits, "key").groupBy("host", "cut")
            .agg(F.max_by(F.struct("key", "list_verdict"), F.struct(F.length("key"), "host_len")).alias("hit"))
            .select("host", "cut", F.col("hit.key").alias("listed"), "hit.list_verdict"))
    return rows.join(best, ["host", "cut"], "left")


def host_list(pages: DataFrame) -> DataFrame:
    """``entry, verdict``: the crawl's distinct hosts with a blocked word among the words of their labels."""
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host != ''").distinct()
    words = F.split("host", "[.-]")
    return hosts.where(F.arrays_overlap(words, F.array(*[F.lit(w) for w in BLOCK_WORDS]))).select(
        F.col("host").alias("entry"), F.lit("block").alias("verdict"))


def judge(pages: DataFrame, rules: list[tuple[str, str]], entries: DataFrame,
          part_bytes: int = PART_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict, listed``: the longest fitting rule decides, else whether a list entry fits."""
    small_batches(pages.sparkSession)
    none = F.lit(None).cast("string")
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
                        none.alias("rule"), none.alias("verdict"), none.alias("listed"), none.alias("list_verdict"))
    rows = _probe(rows, build(rules), "rule", "verdict")
    table = written(entries.select("entry", "verdict").where("entry != '' and verdict is not null").distinct(), "url-list")
    list_bytes = table.agg(F.sum(F.octet_length("entry") + 17)).first()[0] or 0
    if list_bytes > part_bytes:
        rows = _probe_parts(rows, table, list_bytes, part_bytes)
    elif list_bytes:
        rows = _probe(rows, build(_pairs(table.toArrow())), "listed", "list_verdict")
    return rows.select("page_id", "host", "path", "rule",
                       F.coalesce("verdict", "list_verdict", F.lit("allow")).alias("verdict"), "listed")
