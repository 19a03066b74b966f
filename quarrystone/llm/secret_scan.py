"""Secret scan: candidates by pattern, false positives removed by a random forest.

The forest sees a candidate's length, transitions between character classes,
coverage by dictionary words, likeness to a path, and the words beside it.  It
is trained from a table of labelled findings (text, start, stop, label);
``findings_table`` makes one by rule, since the corpus has none.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.llm.common import pieces, raw_texts

THRESHOLD = 0.5
#: Bound of the labelled findings that a forest is trained on.
MOST_FINDINGS = 20_000
#: Characters before and after a candidate whose words are looked at.
BESIDE = 40
# Forms of secrets, in order of precedence: marks of which a text must hold one, and the pattern.
FORMS = {
    "aws_key_id": (("AKIA", "ASIA"), r"\b((?:AKIA|ASIA)[0-9A-Z]{16})\b"),
    "github_token": (("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"\b(gh[pousr]_[A-Za-z0-9]{36,})\b"),
    "slack_token": (("xox",), r"\b(xox[abprs]-[A-Za-z0-9-]{10,})"),
    "api_key": (("sk-",), r"\b(sk-[A-Za-z0-9_-]{20,})"),
    "google_key": (("AIza",), r"\b(AIza[A-Za-z0-9_-]{35})"),
    "stripe_key": (("sk_live_", "rk_live_"), r"\b([sr]k_live_[A-Za-z0-9]{16,})"),
    "gitlab_token": (("glpat-",), r"\b(glpat-[A-Za-z0-9_-]{20,})"),
    "url_password": (("://",), r"://[^\s:/@\"']++:([^\s@/\"']{6,}+)@"),
    "jwt": (("eyJ",), r"\b(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"),
    "private_key": (("PRIVATE KEY",), r"(-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]|-(?!----))*+-----END [A-Z ]*PRIVATE KEY-----)?)"),
    "bearer": (("earer",), r"\b[Bb]earer\s+([A-Za-z0-9._~+/-]{12,}=*)"),
    "assignment": (("=", ":"), r"[:=]\s*+[\"']?+([^\s\"',;]{6,})"),
    "blob": ((), r"([A-Za-z0-9+/_=-]{24,})"),
}
# Names of what is assigned.
_NAMED = re.compile(r"(?i)password|passwd|pwd|secret|token|api_?key|access_?key|auth")
# Words beside a candidate that speak for and against a secret.
FOR = frozenset("key keys secret secrets token tokens password passwd pwd passphrase auth authorization bearer credential credentials aws api private access login".split())
AGAINST = frozenset("example examples sample dummy test placeholder fake your changeme redacted commit sha sha1 sha256 sha512 md5 checksum digest hash uuid guid revision integrity version path file http https import package class function".split())
FEATURES = ("length", "distinct", "entropy", "transitions", "digits", "upper", "dictionary", "path", "hex", "prefixed", "for", "against", "runs")
#: An address among the neighbouring words; a name such as example.com in it says nothing against a secret.
_ADDRESS = re.compile(r"\S*\w[.@/]\w\S*")
_WORD = re.compile(r"[A-Za-z][a-z]+|[A-Za-z]+[0-9]*|[0-9]+")
_PATTERNS = {form: re.compile(pattern) for form, (_, pattern) in FORMS.items()}


def assigned_name(text: str, at: int) -> str:
    """The letters and underscores before the sign at ``at``, past a quote and white space."""
    while at and text[at - 1].isspace():
        at -= 1
    at -= at > 0 and text[at - 1] in "\"'"
    start = at
    while start and (text[start - 1] == "_" or (text[start - 1].isascii() and text[start - 1].isalpha())):
        start -= 1
    return text[start:at]


def candidates(text: str) -> list[tuple[str, int, int]]:
    """(form, start, stop) of each candidate, left to right; of two that overlap the earlier form stays."""
    found: list[tuple[int, int, str]] = []
    for form, (marks, _) in FORMS.items():
        if marks and not any(m in text for m in marks):
            continue
        for m in _PATTERNS[form].finditer(text):
            start, stop = m.span(1)
            if form == "assignment" and not _NAMED.search(assigned_name(text, m.start())):
                continue
            if form == "blob" and not (any(c.isdigit() for c in m[1]) and any(c.isalpha() for c in m[1])):
                continue
            at = bisect.bisect_left(found, (start,))
            if (at == 0 or found[at - 1][1] <= start) and (at == len(found) or stop <= found[at][0]):
                found.insert(at, (start, stop, form))
    return [(form, a, b) for a, b, form in found]


@cache
def _longest(dictionary: frozenset[str]) -> int:
    return max(map(len, dictionary), default=0)


def coverage(value: str, dictionary: frozenset[str]) -> float:
    """Share of the characters that the longest dictionary words from the left take."""
    low, at, taken, longest = value.lower(), 0, 0, _longest(dictionary)
    while at < len(low):
        size = next((n for n in range(min(longest, len(low) - at), 3, -1) if low[at : at + n] in dictionary), 0)
        taken += size
        at += size or 1
    return taken / max(1, len(low))


def features(text: str, form: str, start: int, stop: int, dictionary: frozenset[str]) -> list[float]:
    """The FEATURES of a candidate, from its whole value."""
    value = text[start:stop]
    n = max(1, len(value))
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value]
    counts = Counter(value)
    left, right = text[max(0, start - BESIDE) : start], text[stop : stop + BESIDE // 2]
    before = {w.lower() for w in _WORD.findall(left)}
    beside = {w.lower() for w in _WORD.findall(f"{_ADDRESS.sub(' ', left)} {_ADDRESS.sub(' ', right)} {value}")}
    return [
        math.log2(n), len(counts) / n, -sum(c / n * math.log2(c / n) for c in counts.values()),
        sum(a != b for a, b in zip(kinds, kinds[1:])) / n, kinds.count("d") / n, kinds.count("u") / n, coverage(value, dictionary),
        (value.count("/") + value.count(".") + value.count("\\")) / n + bool(re.search(r"\.[a-z]{1,4}$", value)), float(bool(re.fullmatch("[0-9a-fA-F-]+", value))),
        float(form not in ("assignment", "bearer", "blob", "url_password")), float(len(before & FOR)), float(len(beside & AGAINST)),
        sum(a == b or ord(b) - ord(a) == 1 for a, b in zip(value, value[1:])) / n,
    ]


@dataclass
class Forest:
    """Trees as rows (feature, threshold, left, right, value); feature -1 is a leaf."""

    trees: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := tree[at, 0] >= 0).any():
                row = np.flatnonzero(inner)
                node = tree[at[row]]
                low = x[row, node[:, 0].astype(np.int64)] <= node[:, 1]
                at[row] = np.where(low, node[:, 2], node[:, 3]).astype(np.int64)
            total += tree[at, 4]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> np.ndarray:
    rows: list[list[float]] = []

    def node(index: np.ndarray, level: int) -> int:
        me = len(rows)
        share = y[index].mean()
        rows.append([-1, 0, 0, 0, share])
        if level == depth or len(index) < 2 * least or share in (0, 1):
            return me
        best = (share * (1 - share) * len(index) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(1, math.isqrt(x.shape[1])), replace=False):
            values = x[index, f]
            for cut in np.unique(np.quantile(values, np.linspace(0.05, 0.95, 15))):
                low = values <= cut
                a = low.sum()
                if least <= a <= len(index) - least:
                    p, q = y[index[low]].mean(), y[index[~low]].mean()
                    best = min(best, (p * (1 - p) * a + q * (1 - q) * (len(index) - a), int(f), float(cut)))
        if best[1] >= 0:
            low = x[index, best[1]] <= best[2]
            left, right = node(index[low], level + 1), node(index[~low], level + 1)
            rows[me] = [best[1], best[2], left, right, share]
        return me

    node(rng.integers(0, len(y), len(y)), 0)
    return np.array(rows)


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 3) -> Forest:
    """Bootstrapped trees of Gini splits over random feature subsets; no findings give a forest that answers 1."""
    if not len(y):
        return Forest([np.array([[-1.0, 0, 0, 0, 1]])])
    rng = np.random.default_rng(seed)
    return Forest([_grow(x, y.astype(float), rng, depth, least) for _ in range(trees)])


def labelled_findings(n: int = 1500, seed: int = 23) -> list[tuple[str, int, int, int]]:
    """(text, start, stop, label): n secrets and n look-alikes, by rule."""
    rnd = random.Random(seed)
    low, up, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    pick = lambda chars, size: "".join(rnd.choice(chars) for _ in range(size))
    syllables = ["the", "re", "on", "tion", "an", "er", "ment", "que", "lich", "sch", "ar", "in", "ed", "ly", "os", "al"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 3)))
    plain = ["config", "build", "module", "service", "handler", "user", "value", "index", "table", "report", "client", "update", "manager", "factory", "default"]
    secrets = [
        lambda: ("", "AKIA" + pick(up + digit, 16)), lambda: ("", "ghp_" + pick(low + up + digit, 36)), lambda: ("", "sk-" + pick(low + up + digit, rnd.randint(24, 48))),
        lambda: (rnd.choice(["password=", "password: ", "pwd = ", "passwd="]), pick(digit + "abcdef", rnd.randint(12, 24))),
        lambda: (rnd.choice(["password=", "secret: "]), pick(low + up + digit + "!@#%^", rnd.randint(10, 20))),
        lambda: (rnd.choice(['token = "', "api_key=", "access_token: ", "auth_token = '"]), pick(digit + "abcdef", rnd.choice([32, 40, 64]))),
        lambda: (rnd.choice(["secret_key = ", "api_key: "]), base64.b64encode(rnd.randbytes(rnd.randint(20, 40))).decode()),
        lambda: ("Authorization: Bearer ", pick(low + up + digit + "-_", rnd.randint(24, 60))),
        lambda: ("xoxb token ", "xoxb-" + pick(digit, 12) + "-" + pick(low + up + digit, 24)),
    ]
    others = [
        lambda: (rnd.choice(["password=", "token: ", "secret = ", "api_key="]), rnd.choice(["changeme", "your_password_here", "your-token", "xxxxxxxxxxxx", "<password>", "${PASSWORD}", "example_key", "placeholder", "********", "1234567890", "abcdefgh12345"])),
        lambda: ("", "/".join(rnd.choice(plain) for _ in range(rnd.randint(4, 6))) + f"/v{rnd.randint(1, 9)}"),
        lambda: (rnd.choice(["commit ", "sha256 ", "checksum: ", "revision ", "md5 digest "]), pick(digit + "abcdef", rnd.choice([32, 40, 64]))),
        lambda: (rnd.choice(["uuid ", "guid: ", "id "]), "-".join(pick(digit + "abcdef", k) for k in (8, 4, 4, 4, 12))),
        lambda: ("", "_".join(rnd.choice(plain) for _ in range(rnd.randint(4, 6))) + str(rnd.randint(1, 99))),
        lambda: ("", "".join(rnd.choice(plain).title() for _ in range(rnd.randint(4, 6))) + str(rnd.randint(1, 9))),
        lambda: ("integrity ", "sha512-" + base64.b64encode(rnd.randbytes(32)).decode()),
        lambda: (rnd.choice(["token=", "password: "]), rnd.choice(plain) + "." + rnd.choice(plain) + "()"),
        lambda: ("", pick("-=_", rnd.randint(20, 30)) + "section" + str(rnd.randint(1, 99))),
    ]
    out = []
    for label, makers in ((1, secrets), (0, others)):
        for i in range(n):
            lead, value = makers[i % len(makers)]()
            head = " ".join(word() for _ in range(rnd.randint(0, 8)))
            if rnd.random() < 0.2:  # an address near by says nothing
                head = f"{head} {word()}@example.{rnd.choice(['com', 'org'])} {word() if rnd.random() < 0.5 else ''}".strip()
            if not label and rnd.random() < 0.4:  # a secret's name stands near, but not for this value
                head = f"{head} {rnd.choice(['password', 'token', 'secret', 'api key', 'login'])}{rnd.choice(['', '=changeme'])} {word()}"
            head = f"{head} {lead}" if head else lead
            out.append((f"{head}{value} {' '.join(word() for _ in range(rnd.randint(0, 6)))}", len(head), len(head) + len(value), label))
    return out


def findings_table(spark: SparkSession, n: int = 1500, seed: int = 23) -> DataFrame:
    """``labelled_findings`` as a table (text, start, stop, label)."""
    return spark.createDataFrame(labelled_findings(n, seed), "text string, start long, stop long, label int")


def fit_findings(findings: DataFrame, dictionary: frozenset[str], most: int = MOST_FINDINGS, **settings) -> Forest:
    """A forest from the ``most`` labelled findings of least hash; each gets the form of the candidate that covers it.

    Findings of null text, place or label teach nothing; equal findings count
    as one.  An empty table gives a forest that answers 1.
    """
    able = findings.select("text", "start", "stop", "label").dropna().distinct()
    picked = able.orderBy(F.xxhash64("text", "start", "stop", "label"), "text", "start", "stop", "label").limit(most)
    rows, labels = [], []
    for text, start, stop, label in picked.collect():
        form = next((f for f, a, b in candidates(text) if a < stop and start < b), "blob")
        rows.append(features(text, form, start, stop, dictionary))
        labels.append(label)
    return train_forest(np.array(rows), np.array(labels), **settings)


def scan_secrets(docs: DataFrame, forest: Forest, dictionary: frozenset[str], doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(id, start, length, form, value_sha256, score, is_secret) of each candidate.

    ``start`` and ``length`` count code points.  The value itself is not
    given, only its hash.  A value is judged by all its characters, however
    long.  Null and empty texts have no candidate; rows of null or equal id
    are each scanned, so equal rows give equal findings.  Of two candidates
    that overlap the form named first in FORMS stays.  An empty table gives
    an empty result.  No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((forest, dictionary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, known = shared.value
        for piece in pieces(batches, "text"):
            rows, x = [], []
            for name, raw in zip(piece.column("id").to_pylist(), raw_texts(piece.column("text"))):
                body = raw.decode("utf-8")
                for form, start, stop in candidates(body):
                    rows.append((name, start, stop - start, form, hashlib.sha256(body[start:stop].encode()).hexdigest()))
                    x.append(features(body, form, start, stop, known))
            if rows:
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(trees.score(np.array(x)))], ["id", "start", "length", "form", "value_sha256", "score"])

    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    out = rows.mapInArrow(run, "id long, start long, length long, form string, value_sha256 string, score double")
    return out.withColumnRenamed("id", doc_id).withColumn("is_secret", F.col("score") >= threshold)
