"""URL filter: a sorted array of 64-bit digests, memory-mapped and probed by binary search.

The rule list becomes one file: sorted xxhash64 digests of the rule strings, and the strings
themselves in the same order. The driver ships the file with ``SparkContext.addFile``; every
worker maps it, so its pages are shared by the workers of a machine and nothing is parsed.
A batch of urls is expanded to the strings that could be rules for it (host suffix plus path
prefix of a length that occurs in the list), their digests are searched in one vectorised
binary search, and each hit is confirmed on the stored string. No shuffle, no join.

The list is bounded by ``max_rules``; a longer one is an error, never cut.
"""

from __future__ import annotations

import os
import re
import uuid

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from spectrafold.llm.frames import mapped, offered

MAX_RULES = 10_000_000
VERDICTS = ("allow", "block")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a url; both empty if it is null or has no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host, path = _PARTS.match(rest).groups()
    return host.translate(_UPPER), path


class DigestArray:
    """Sorted digests with their strings and verdicts, in one file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            n, lengths, self.labels = np.frombuffer(f.read(24), np.int64).tolist()
        at = 24
        self.lengths = np.memmap(path, np.int64, "r", at, (lengths,)).tolist()
        at += 8 * lengths
        self.digest = np.memmap(path, np.uint64, "r", at, (n,)) if n else np.zeros(0, np.uint64)
        at += 8 * n
        self.offset = np.memmap(path, np.int64, "r", at, (n + 1,))
        at += 8 * (n + 1)
        size = os.path.getsize(path) - at
        self.text = np.memmap(path, np.uint8, "r", at, (size,)) if size else np.zeros(0, np.uint8)

    @staticmethod
    def write(path: str, rules: dict[str, str], lengths: list[int], labels: int) -> None:
        """``lengths``: of rule paths; ``labels``: most labels in a rule's host."""
        keys = [k.encode() for k in rules]
        digest = np.array([xxhash.xxh64_intdigest(k) for k in keys], np.uint64)
        order = np.lexsort((np.arange(len(keys)), digest))
        stored = [bytes([VERDICTS.index(rules[keys[i].decode()])]) + keys[i] for i in order]
        offset = np.concatenate([[0], np.cumsum([len(s) for s in stored], dtype=np.int64)])
        with open(path, "wb") as f:
            f.write(np.array([len(keys), len(lengths), labels], np.int64).tobytes())
            f.write(np.array(lengths, np.int64).tobytes())
            f.write(digest[order].tobytes())
            f.write(offset.astype(np.int64).tobytes())
            f.write(b"".join(stored))

    def find(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key that is in the list, else None."""
        raw = [k.encode("utf-8", "surrogatepass") for k in keys]
        probes = np.array([xxhash.xxh64_intdigest(k) for k in raw], np.uint64)
        at = np.searchsorted(self.digest, probes)
        out: list[str | None] = [None] * len(keys)
        held = at < len(self.digest)
        held[held] = self.digest[at[held]] == probes[held]
        for i in np.flatnonzero(held).tolist():
            k = int(at[i])
            while k < len(self.digest) and self.digest[k] == probes[i]:  # equal digests
                entry = self.text[self.offset[k] : self.offset[k + 1]].tobytes()
                if entry[1:] == raw[i]:
                    out[i] = VERDICTS[entry[0]]
                    break
                k += 1
        return out


def publish(rules: DataFrame, max_rules: int = MAX_RULES) -> str:
    """Ship the rules (host, path, verdict) to every worker; returns the file's name.

    Rules with a null, and verdicts other than allow or block, are errors. Of rules with equal
    host and path, block wins.
    """
    spark = rules.sparkSession
    rows = rules.select("host", "path", "verdict").limit(max_rules + 1).collect()
    if len(rows) > max_rules:
        raise ValueError(f"the list has more than max_rules = {max_rules} rules")
    kept: dict[str, str] = {}
    for host, path, verdict in rows:
        if host is None or path is None or verdict not in VERDICTS:
            raise ValueError(f"not a rule: {(host, path, verdict)}")
        key = host.translate(_UPPER) + path
        kept[key] = max(verdict, kept.get(key, verdict))
    lengths = sorted({len(r.path) for r in rows})
    name = f"rules-{uuid.uuid4().hex}.bin"
    labels = max((r.host.count(".") + 1 for r in rows), default=0)
    path = offered(name)
    DigestArray.write(path, kept, lengths, labels)
    spark.sparkContext.addFile(path)
    return name


def _candidates(host: str, path: str, listed: DigestArray) -> list[str]:
    """Strings that would be a rule for the url, the longest first."""
    labels = host.rsplit(".", listed.labels)[-listed.labels :] if listed.labels else []
    if host.count(".") < listed.labels:
        labels = host.split(".")
    found = [
        ".".join(labels[k:]) + path[:n]
        for k in range(len(labels))
        for n in listed.lengths
        if n <= len(path)
    ]
    return sorted(found, key=len, reverse=True)


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow",
    max_rules: int = MAX_RULES,
) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict added.

    A rule fits its host and all subdomains if the url's path starts with the rule's path; the
    longest wins. Urls that no rule fits, null ones included, get ``default``. Columns of
    ``pages`` that have one of the new names are replaced. An empty table stays empty, an
    empty list gives ``default`` throughout; repeated rows are judged alike.
    """
    name = publish(rules, max_rules)

    def start():
        listed = DigestArray(SparkFiles.get(name))

        def compute(given):
            split = [parts(u) for u in given]
            owner, keys = [], []
            for k, (host, path) in enumerate(split):
                for key in _candidates(host, path, listed):
                    owner.append(k)
                    keys.append(key)
            rule: list[str | None] = [None] * len(split)
            verdict = [default] * len(split)
            for k, key, said in zip(owner, keys, listed.find(keys)):
                if said is not None and rule[k] is None:
                    rule[k], verdict[k] = key, said
            return {
                "host": [h for h, _ in split], "path": [p for _, p in split], "rule": rule, "verdict": verdict,
            }

        return compute

    return mapped(pages, "host string, path string, rule string, verdict string", start, [url])
