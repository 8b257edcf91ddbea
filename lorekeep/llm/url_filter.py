"""URL filter over a sorted digest array.

Rules (host and path prefix, allow or block) are kept as a file: their 64-bit xxhash keys in ascending order, and beside
them the full rule strings. The driver makes the file, and holds the list it is given while it does. Each executor gets the file through Spark's file distribution and maps it into memory, so
that a list of any length costs one copy of pages for each machine. A URL's probes are its host and every parent domain,
each with every path prefix whose length some rule has; all probes of a batch go through one vectorised binary search,
and a key that is found counts only if the stored string is the probe's.

Defined results: a null URL, or one without ://, has empty host and path and meets no rule. The longest rule that fits
wins. Without one the verdict is ``default`` (a URL that the list does not name is allowed). An empty table gives an
empty table; equal URLs get equal verdicts; only page_id and url of the input are read, so extra columns don't matter.
"""

from __future__ import annotations

import atexit
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_batches

HEAD = struct.Struct("<8sQQ")
MAGIC = b"LKURL001"


def write_rules(rules: Iterable[tuple[str, str]], path: str) -> None:
    """The digest file of (host/path, verdict) pairs: header, keys ascending, string ends, verdicts, strings, path lengths."""
    unique = dict(rules)
    for rule, verdict in unique.items():
        if "/" not in rule or rule.startswith("/") or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {rule!r} {verdict!r}")
    keyed = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in unique.items())
    lengths = np.unique(np.array([len(r) - r.index("/") for r in unique] or [0], dtype="<u8"))
    with open(path, "wb") as f:
        f.write(HEAD.pack(MAGIC, len(keyed), len(lengths)))
        f.write(np.array([k for k, _, _ in keyed], dtype="<u8").tobytes())
        f.write(np.cumsum([0, *(len(r) for _, r, _ in keyed)], dtype="<u8").tobytes())
        f.write(lengths.tobytes())
        f.write(bytes(v == "block" for _, _, v in keyed))
        f.write(b"".join(r for _, r, _ in keyed))


class RuleFile:
    """The mapped file. ``find`` answers probes; ``lengths`` are the path lengths that occur in rules."""

    def __init__(self, path: str):
        raw = np.memmap(path, dtype=np.uint8, mode="r")
        magic, n, n_lengths = HEAD.unpack(raw[: HEAD.size].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path} is not a rule file")
        at = HEAD.size
        self.keys, at = raw[at : at + 8 * n].view("<u8"), at + 8 * n
        self.ends, at = raw[at : at + 8 * (n + 1)].view("<u8"), at + 8 * (n + 1)
        self.lengths, at = [int(x) for x in raw[at : at + 8 * n_lengths].view("<u8")], at + 8 * n_lengths
        self.block, self.text = raw[at : at + n], raw[at + n :]

    def find(self, probes: list[bytes]) -> np.ndarray:
        """For each probe its rule's number, -1 if there is none."""
        if not probes or not len(self.keys):
            return np.full(len(probes), -1)
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, probes), dtype="<u8", count=len(probes))
        at = np.searchsorted(self.keys, wanted)
        out = np.full(len(probes), -1)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == wanted):
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == wanted[i]:  # keys that collide are neighbours
                if self.string(k) == probes[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def string(self, k: int) -> bytes:
        return self.text[int(self.ends[k]) : int(self.ends[k + 1])].tobytes()


UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path as the rules see them."""
    _, sep, rest = (url or "").partition("://")
    if not sep:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(UPPER), path[:stop]


def parents(host: str) -> list[str]:
    """The host and its parent domains, longest first."""
    out = [host] if host else []
    while "." in host:
        host = host.partition(".")[2]
        if host:
            out.append(host)
    return out


def judge_urls(urls: Iterable[str | None], rules: RuleFile, default: str) -> list[tuple[str, str, str | None, str]]:
    """(host, path, rule, verdict) for each URL."""
    split = [split_url(u) for u in urls]
    probes: list[bytes] = []
    owner: list[int] = []
    for i, (host, path) in enumerate(split):
        for h in parents(host):
            for n in rules.lengths:
                if n <= len(path):
                    probes.append(f"{h}{path[:n]}".encode("utf-8", "surrogatepass"))
                    owner.append(i)
    best: dict[int, int] = {}
    hits = rules.find(probes)
    for j in np.flatnonzero(hits >= 0):
        i, k = owner[j], int(hits[j])
        if i not in best or len(probes[j]) > len(rules.string(best[i])):
            best[i] = k
    return [
        (h, p, rules.string(best[i]).decode() if i in best else None, ("block" if rules.block[best[i]] else "allow") if i in best else default)
        for i, (h, p) in enumerate(split)
    ]


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str]], key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """Judge every URL; the rule file reaches executors through SparkContext.addFile, late ones too."""
    folder = tempfile.mkdtemp(prefix="lorekeep-url-")
    atexit.register(shutil.rmtree, folder, True)  # the driver serves the file from there as long as it lives
    name = f"{os.path.basename(folder)}.rules"
    write_rules(rules, f"{folder}/{name}")
    pages.sparkSession.sparkContext.addFile(f"{folder}/{name}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = RuleFile(SparkFiles.get(name))
        for b in batches:
            judged = pd.DataFrame(judge_urls(b["url"], opened, default), columns=["host", "path", "rule", "verdict"], dtype=object)
            judged.insert(0, "page_id", b["page_id"].to_numpy())
            yield judged

    kind = pages.schema[key].dataType.simpleString()
    return in_batches(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"))).mapInPandas(run, f"page_id {kind}, host string, path string, rule string, verdict string")
