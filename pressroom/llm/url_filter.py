"""URL filter over a sorted array of 64-bit xxhash digests.

The rules (a host and the beginning of a path, each with a verdict) are hashed, sorted by digest
and laid out as plain files: the digests, then the rule strings in the same order. Executors get
the files through Spark, map them into memory (pages come and go, no task holds the list), probe
with a vectorised binary search and compare the stored string of every digest that fits, so a
collision never decides.

A rule fits its host and all subdomains when the url's path starts with the rule's path; the
longest rule wins (then the longer host). A rule with an empty path fits every url of its host. Urls
that no rule fits get ``default``. A rule with a null, or with a path that is neither empty nor begins
with ``/``, could never fit: such rules are an error.

Host: what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path:
from there up to ``?``, ``#`` or the end. A null url or one without ``://`` has both empty and
fits no rule. Very long urls are judged whole: only suffixes of the host as long as a rule's host are
looked up, so their number and bytes follow the rules. Repeated rows are judged row by row; an empty table gives no rows; of equal rules
with different verdicts the smallest verdict stands; other columns of ``pages`` pass through,
but those named like a result (host, path, rule, verdict) are replaced.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from pressroom.session import scratch_path

RESULT = ("host", "path", "rule", "verdict")
DOT = ord(".")


def _lay_out(rules: list[tuple[str, str]]) -> bytes:
    """A block of rules in digest order: counts, (host length, path length) of the rules, each pair
    once, digests, ends of strings, verdict numbers, verdict names, strings."""
    texts = [r.encode() for r, _ in rules]
    digests = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64)
    order = np.argsort(digests, kind="stable")
    names = sorted({v for _, v in rules})
    verdicts = np.array([names.index(rules[i][1]) for i in order], np.int64)
    ends = np.cumsum([len(texts[i]) for i in order], dtype=np.int64)
    hosts = [t.index(b"/") if b"/" in t else len(t) for t in texts]
    lengths = np.array(sorted({(h, len(t) - h) for h, t in zip(hosts, texts, strict=True)}), np.int64).reshape(-1, 2)
    listed = "\n".join(names).encode()
    head = np.array([len(rules), len(lengths), len(listed)], np.int64)
    return b"".join([head.tobytes(), lengths.tobytes(), digests[order].tobytes(), ends.tobytes(), verdicts.tobytes(),
                     listed, b"".join(texts[i] for i in order)])


class DigestArray:
    """One block, mapped into memory."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, k, m = (int(x) for x in raw[:24].view(np.int64))
        cut = np.cumsum([24, 16 * k, 8 * n, 8 * n, 8 * n, m])
        self.lengths: dict[int, list[int]] = {}  # path lengths by host length
        for host, path in raw[cut[0]: cut[1]].view(np.int64).reshape(-1, 2).tolist():
            self.lengths.setdefault(host, []).append(path)
        self.digests = raw[cut[1]: cut[2]].view(np.uint64)
        self.ends = raw[cut[2]: cut[3]].view(np.int64)
        self.verdicts = raw[cut[3]: cut[4]].view(np.int64)
        self.names = raw[cut[4]: cut[5]].tobytes().decode().split("\n")
        self.strings = raw[cut[5]:]

    def string(self, i: int) -> bytes:
        return self.strings[(int(self.ends[i - 1]) if i else 0): int(self.ends[i])].tobytes()

    def keys(self, host: bytes, path: bytes) -> Iterator[tuple[bytes, int]]:
        """(key, bytes of its host) of what could be a rule: the host or a parent domain of it, as long as
        the host of some rule, and the beginning of the path, as long as a path beside such a host. So a
        host of any length makes no more keys than the rules have lengths."""
        for n, tails in self.lengths.items():
            at = len(host) - n
            if host and (at == 0 or at > 0 and host[at - 1] == DOT):
                for m in tails:
                    if m <= len(path):
                        yield host[at:] + path[:m], n

    def probe(self, keys: list[bytes]) -> Iterator[tuple[int, str]]:
        """(place in keys, verdict) of the keys that are rules."""
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        low, high = np.searchsorted(self.digests, digests, "left"), np.searchsorted(self.digests, digests, "right")
        for at in np.flatnonzero(high > low):
            for i in range(low[at], high[at]):
                if self.string(i) == keys[at]:
                    yield int(at), self.names[self.verdicts[i]]
                    break


def build(rules: DataFrame, block_rules: int = 4_000_000) -> list[str]:
    """Lay out rules (host, path, verdict) in blocks of at most ``block_rules`` and hand the files
    to the executors; returns their names. The driver holds one block at a time."""
    spark = rules.sparkSession
    key = F.concat(F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.col("path"))
    fits = F.col("host").isNotNull() & F.col("verdict").isNotNull() & ((F.col("path") == "") | F.col("path").startswith("/"))
    unusable = rules.filter(~F.coalesce(fits, F.lit(False))).limit(5).collect()
    if unusable:
        raise ValueError(f"rules that can fit no url: {unusable}")
    ready = rules.groupBy(key.alias("rule")).agg(F.min("verdict").alias("verdict"))
    hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
    names, block = [], []

    def put() -> None:
        where = scratch_path(spark, "url-rules")
        path = hadoop.Path(where)
        out = path.getFileSystem(conf).create(path)
        out.write(bytearray(_lay_out(block)))
        out.close()
        spark.sparkContext.addFile(where)
        names.append(os.path.basename(where))
        block.clear()

    for row in ready.orderBy("rule").toLocalIterator():
        block.append((row["rule"], row["verdict"]))
        if len(block) >= block_rules:
            put()
    if block:
        put()
    return names


def split_url(url: str | None) -> tuple[str, str]:
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    stop = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    slash = rest.find("/", 0, stop)
    host, path = (rest[:stop], "") if slash < 0 else (rest[:slash], rest[slash:stop])
    return host.encode().lower().decode(), path


def judge(pages: DataFrame, names: list[str], default: str = "allow", url: str = "url") -> DataFrame:
    """Add host, path, rule (null where none fits) and verdict to every row."""
    keep = [c for c in pages.columns if c.lower() not in RESULT]
    source = pages.select(*[F.col(f"`{c}`") for c in keep])
    schema = StructType(list(source.schema.fields))
    for c in RESULT:
        schema = schema.add(c, "string")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [DigestArray(SparkFiles.get(n)) for n in names]
        for part in parts:
            split = [split_url(u) for u in part.column(url).to_pylist()]
            best: list[tuple[int, int, str, str] | None] = [None] * len(split)
            for block in blocks:
                keys, rows = [], []
                for i, (host, path) in enumerate(split):
                    for key, host_bytes in block.keys(host.encode(), path.encode()):
                        keys.append(key)
                        rows.append((i, host_bytes))
                for at, verdict in block.probe(keys):
                    i, host_bytes = rows[at]
                    rule = keys[at].decode()
                    found = (len(rule), host_bytes, rule, verdict)
                    if best[i] is None or found[:2] > best[i][:2]:
                        best[i] = found
            add = [[h for h, _ in split], [p for _, p in split], [b and b[2] for b in best], [b[3] if b else default for b in best]]
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(a, pa.string()) for a in add]], names=[*part.schema.names, *RESULT])

    return source.mapInArrow(batches, schema)
