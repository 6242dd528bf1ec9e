"""Secret scans: candidates by shape, false positives removed by a random forest."""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.registry import query, table

NEAR = 48  # characters before and after a candidate that count as its neighbourhood
MASK = "[SECRET]"

# Borders are those of ASCII words, so that letters of other scripts may touch a secret. In turn: a private key block, closed or open up to the first line that
# is no base64; the password of a URL; any value that a secret word is given; a known prefix with at least 16 more characters; a run of at least 12 with a digit.
CANDIDATE = re.compile(
    r"(?P<pem>-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:(?:[A-Za-z0-9+/=\s\\]|Proc-Type:[^\n]*|DEK-Info:[^\n]*)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\r?\n[A-Za-z-]{2,20}: [^\n]*)*+(?:\r?\n){0,2}(?:[A-Za-z0-9+/=]{16,}(?:\r?\n|$|(?=[^A-Za-z0-9+/=])))+))"
    r"|://[^\s/:@\"'<>]{1,64}:(?P<url>[^\s/@\"'<>]{4,128})(?=@)"
    r"|(?:pass(?!age|enger)|pwd|secret(?!ar)|token|key(?!board|word)|auth(?!or)|cred|PASS|PWD|SECRET|TOKEN|KEY|AUTH|CRED|Pass|Secret|Token|Key|Auth(?!or))[A-Za-z0-9_-]{0,24}[\"']?[ \t]{0,3}(?:=>|:=|=|:)[ \t]{0,3}"
    r"(?:\"(?P<quoted>[^\"\n]{4,200})\"|'(?P<single>[^'\n]{4,200})'|(?P<value>[^\s\"'`,;<>(){}\[\]\u0080-\U0010ffff]{6,200}))"
    r"|(?<![A-Za-z0-9_+/\-])(?P<prefix>(?:A[KS]IA|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ|glpat-)[A-Za-z0-9_+/\-]{16,}={0,2})"
    r"|(?<![A-Za-z0-9_+/\-])(?P<run>(?=[A-Za-z_+/\-]*[0-9])[A-Za-z0-9_+/\-]{12,}={0,2})(?![A-Za-z0-9_])")
KNOWN = re.compile(r"A[KS]IA[A-Z0-9]{16}|gh[pousr]_|github_pat_|sk-|xox[abprs]-|AIza|eyJ|glpat-")
UNLIKELY_PATHS = ("test", "example", "sample", "fixture", "doc", "readme", "spec", "mock")
LIKELY_PATHS = ("config", "settings", ".env", "deploy", "prod", "secret", "credential", "src/")

SECRET_WORDS = ("token", "key", "secret", "password", "passwd", "pwd", "api", "auth", "bearer", "credential", "access", "private")
OTHER_WORDS = ("commit", "sha", "hash", "checksum", "md5", "digest", "uuid", "guid", "card", "visa", "iban", "phone", "tel", "fax", "order", "isbn",
               "serial", "version", "build", "etag", "revision", "id", "example", "sample", "date", "time")
# words of identifiers and placeholders
DICTIONARY = frozenset(
    "access account admin api application archive array backup base batch bucket build cache card case class client cluster code config connection content "
    "count data database date default demo device document dummy email example file filter format function general group handler header here host image "
    "index info input insert integer item key label large latest layer level library line list local log main manager master message method mode model module "
    "name network node number object option order output packet page param parser password path pattern phone placeholder point policy port private product "
    "profile project proxy public query queue random record region release report request resource response result root sample schema script secret section "
    "server service session set setting size small source stage start state status step store stream string style system table tag target task template test "
    "text thread time title token type update upload user utf value version view web window word worker your zone changeme".split())


@dataclass(frozen=True)
class Finding:
    """A candidate with its neighbourhood and the path of its document."""
    kind: str
    text: str
    before: str = ""
    after: str = ""
    path: str = ""


def findings(text: str | None, path: str | None = None) -> Iterator[tuple[int, Finding]]:
    """(start, finding) of every candidate of a text."""
    for m in CANDIDATE.finditer(text or ""):
        start, end = m.span(m.lastgroup)
        kind = "value" if m.lastgroup in ("quoted", "single") else m.lastgroup
        yield start, Finding(kind, text[start:end], text[max(0, start - NEAR):start], text[end:end + NEAR], path or "")


def _kind_of(c: str) -> str:
    return "d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s"


def _coverage(text: str) -> float:
    """Share of the characters in words of the dictionary, longest first from the left."""
    low, at, covered = text.lower(), 0, 0
    while at < len(low):
        for size in range(min(12, len(low) - at), 2, -1):
            if low[at:at + size] in DICTIONARY:
                covered += size
                at += size
                break
        else:
            at += 1
    return covered / max(1, len(low))


def _near(words: list[str], of: tuple[str, ...]) -> int:
    return sum(any(w == x or (len(x) > 3 and x in w) for x in of) for w in words)


def measures(f: Finding) -> list[float]:
    """What the forest sees: length, characters and their transitions, dictionary coverage, path and neighbouring words."""
    t = f.text
    kinds, counts, n = [_kind_of(c) for c in t], Counter(t), len(t)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    steps = Counter(zip(kinds, kinds[1:]))
    same = steps["d", "d"] + steps["u", "u"] + steps["l", "l"]
    alphabetic = [abs(ord(a) - ord(b)) <= 1 for a, b in zip(t, t[1:])]  # runs like 1234, abcd, aaaa
    vowels = sum(c in "aeiouAEIOU" for c in t)
    before, after = re.findall(r"[A-Za-z]+\d*", f.before.lower())[-4:], re.findall(r"[A-Za-z]+\d*", f.after.lower())[:2]
    tight = f.before[-3:].strip(" \"'")
    whole = re.split(r"\s", f.before)[-1] + t + re.split(r"\s", f.after)[0]
    return [
        n, entropy, entropy / math.log2(max(2, n)), kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("s") / n, len(counts) / n,
        float(all(c in string.hexdigits for c in t)), same / max(1, n - 1), (steps["d", "l"] + steps["l", "d"]) / max(1, n - 1),
        (steps["d", "u"] + steps["u", "d"]) / max(1, n - 1), (steps["u", "l"] + steps["l", "u"]) / max(1, n - 1), sum(alphabetic) / max(1, n - 1),
        vowels / max(1, kinds.count("u") + kinds.count("l")), _coverage(t), t.count("-") + t.count("_"), t.count("/"), float(bool(KNOWN.match(t))), float(f.kind == "pem"),
        float(f.kind == "value"), float(f.kind == "url"), t.count(" "), sum(c in string.punctuation and c not in "-_" for c in t) / n, float(t[-1:] in ".:!?"),
        _near(before, SECRET_WORDS), _near(before, OTHER_WORDS), _near(after, OTHER_WORDS), _near(before[-1:], SECRET_WORDS), _near(before[-1:], OTHER_WORDS),
        float(tight.endswith(("=", ":"))), float(f.before[-1:] in "\"'" and bool(f.before)), float("://" in whole or whole.startswith(("/", "./"))),
        float("@" in whole), float(any(w in f.path.lower() for w in UNLIKELY_PATHS)),
        float(any(w in f.path.lower() for w in LIKELY_PATHS))]


def examples(count: int = 5000, seed: int = 11) -> list[tuple[Finding, int]]:
    """Labelled findings: secrets and false positives of the usual kinds, made from a seed, with paths; weak values count as secrets in settings and
    sources only, not in tests and documentation. Each is a candidate of a made text, as the scan finds it. Pass findings of your own to
    `train` where reviewed ones exist; the test tables have none."""
    r, lower, upper = random.Random(seed), string.ascii_lowercase, string.ascii_uppercase
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    hexa, mixed = "0123456789abcdef", string.ascii_letters + string.digits
    filler = lambda n: " ".join(some(lower, r.randint(2, 9)) for _ in range(n))
    word = lambda: r.choice(sorted(DICTIONARY))
    dashed = lambda *sizes: "-".join(some(hexa, n) for n in sizes)
    script = lambda: r.choice(["", "", "", "密钥", "キー", "ключ", "é"])

    def assigned(value: str) -> tuple[str, str, str]:
        name = r.choice(SECRET_WORDS)
        name = r.choice([name, name, name.upper(), f"{word()}_{name}", f"{name}_{word()}", "api_key", "client_secret", "password"])
        quote = r.choice(['"', "'", ""])
        return f"{filler(3)} {name}{r.choice(['=', ' = ', ': ', ':'])}{quote}", value, quote + r.choice([" ", ", ", "### ", ". ", "です"]) + filler(2)

    def named(value: str) -> tuple[str, str, str]:
        return f"{filler(3)} {r.choice(OTHER_WORDS[:22])}{r.choice([' ', ': ', '=', ' = '])}{r.choice(['', chr(34)])}", value, f" {filler(2)}"

    def bare(value: str) -> tuple[str, str, str]:
        return filler(4) + " " + script(), value, r.choice([" ", "### ", ", ", ". "]) + filler(2)

    def address(user: str, value: str) -> tuple[str, str, str]:
        return f"{filler(2)} {r.choice(['https', 'postgres', 'ftp', 'redis'])}://{user}:", value, f"@{r.choice(['db', 'host', 'cache'])}.{some(lower, 6)}.{r.choice(['com', 'net'])}/{word()} {filler(1)}"
    weak = [lambda: "".join(some(lower, r.randint(3, 8)) for _ in range(r.randint(2, 4))), lambda: some(lower, r.randint(3, 7)).title() + r.choice("!@#$") + some(string.digits, 4),
            lambda: some(lower, r.randint(8, 14)) + some(string.digits, r.randint(1, 3))]
    strong = lambda: "".join(r.choice(mixed + "!@#$%^&*.?-_") for _ in range(r.randint(10, 24)))
    true = [
        lambda: r.choice([assigned, bare])(r.choice(["AKIA", "ASIA"]) + some(upper + "234567890", 16)),
        lambda: r.choice([assigned, bare])(r.choice(["ghp_", "gho_", "sk-", "xoxb-", "AIza", "glpat-"]) + some(mixed, r.randint(20, 40))),
        lambda: assigned(some(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: assigned(some(hexa, r.choice([16, 18, 20, 24, 32, 40, 64]))),
        lambda: assigned(some(mixed, r.randint(12, 48))),
        lambda: assigned(some(mixed + "+/", r.randint(20, 44)) + r.choice(["", "=", "=="])),
        lambda: bare("-----BEGIN RSA PRIVATE KEY-----\n" + some(mixed + "+/", 300) + "\n-----END RSA PRIVATE KEY-----"),
        lambda: assigned(strong()), lambda: address(some(lower, 6), strong().replace("@", "x")), lambda: address(some(lower, 6), some(mixed, r.randint(8, 20))),
    ]
    likely = ["config/app.yaml", "src/main.py", ".env", "deploy/prod.tf", "settings.py", "src3", "src11", "", ""]
    unlikely = ["tests/test_login.py", "docs/usage.md", "examples/demo.js", "spec/fixtures/user.json", "README.md"]
    false = [
        lambda: named(some(hexa, r.choice([16, 32, 40, 64]))),
        lambda: r.choice([named, bare])(dashed(8, 4, 4, 4, 12)),
        lambda: r.choice([named, bare, bare])(some(string.digits, r.choice([12, 13, 15, 16, 16, 18, 20]))),
        lambda: bare(f"20{some('0123', 2)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}"),
        lambda: r.choice([assigned, bare])("_".join([word(), word(), word(), str(r.randint(1, 99))])),
        lambda: assigned(r.choice(["your", "YOUR", "my", "test", "example", "dummy"]) + r.choice(["_", "-", ""]) + r.choice(["api_key", "token", "secret_key", "password"]) + r.choice(["_123", "", "_here"])),
        lambda: assigned(r.choice(["x" * 14 + "1", "1234567890abcdef", "0" * 20, "abcdef1234567890", "a1" * 8, "123456789012", "********", "changeme", "xxxxxxxx", "password", "${TOKEN}", "$SECRET_KEY", "None", "required", "optional.", "undefined"])),
        lambda: (f"{filler(2)} https://{word()}.{word()}.com/", f"{word()}/{word()}/{r.randint(100, 99999)}/{word()}", f" {filler(2)}"),
        lambda: (filler(3) + " ", f"{word()}-{word()}-v{r.randint(1, 20)}-{r.randint(1, 9)}", f" {filler(2)}"),
        lambda: bare((some(lower, r.randint(9, 14)) + str(r.randint(1, 99))).capitalize()),
        lambda: bare("sk-" + "-".join([word(), word(), word(), word()])),
        lambda: (filler(2) + " ", f"{some(lower, 8)}{r.randint(1000, 9999)}", f"@{word()}.example.com {filler(1)}"),
        lambda: (f"{filler(2)} {r.choice(['author', 'keyboard', 'key', 'password', 'token', 'authors', 'keywords', 'secretary', 'passage', 'passenger'])}: ",
                 r.choice([word(), f"{word()}.{word()}", f"{word()}_{word()}", word().capitalize() + word(), filler(1).title(), "os.environ", "request.headers"]), f" {filler(3)}"),
        lambda: (f'{filler(2)} {r.choice(["password", "token", "key", "secret"])}: "', " ".join(word() for _ in range(r.randint(2, 6))), f'" {filler(2)}'),
        lambda: address(r.choice(["user", "username", "USER", "admin"]), r.choice(["password", "pass", "PASSWORD", "secret", "your_password", "changeme"])),
    ]
    out: list[tuple[Finding, int]] = []
    while len(out) < count:
        c = r.random()
        if c < 0.12:
            label = int(r.random() < 0.5)
            (before, value, after), path = r.choice([assigned, assigned, lambda v: address(some(lower, 5), v.replace("@", "x"))])(r.choice(weak)()), r.choice(likely if label else unlikely)
        else:
            label = int(c < 0.55)
            (before, value, after), path = r.choice(true if label else false)(), r.choice(likely + unlikely)
        start = len(before)
        for at, f in findings(before + value + after, path):
            if at < start + len(value) and start < at + len(f.text):
                out.append((f, label))
    return out


class Forest:
    """Random forest on numbers: every tree sees a bootstrap sample and, at each node, a random part of the columns."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 16, least: int = 1, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[tuple[int, float, int, int, float]] = []  # column or -1, limit, left, right, share of secrets
            self._grow(nodes, x[rows], y[rows].astype(np.float64), depth, least, rng)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes)))

    def _grow(self, nodes: list, x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator) -> int:
        own = len(nodes)
        nodes.append((-1, 0.0, 0, 0, float(y.mean())))
        if not depth or len(y) < 2 * least or y.min() == y.max():
            return own
        best, n = (np.inf, -1, 0.0), len(y)
        for c in rng.choice(x.shape[1], max(1, x.shape[1] // 3), replace=False):
            order = np.argsort(x[:, c], kind="stable")
            v, hits = x[order, c], np.cumsum(y[order])
            cut = np.arange(least, n - least + 1)
            cut = cut[v[cut - 1] < v[np.minimum(cut, n - 1)]]
            if len(cut):
                left, right = hits[cut - 1], hits[-1] - hits[cut - 1]
                impurity = left * (1 - left / cut) + right * (1 - right / (n - cut))
                i = int(impurity.argmin())
                if impurity[i] < best[0]:
                    best = (impurity[i], int(c), float((v[cut[i] - 1] + v[cut[i]]) / 2))
        if best[1] >= 0:
            low = x[:, best[1]] <= best[2]
            left = self._grow(nodes, x[low], y[low], depth - 1, least, rng)
            right = self._grow(nodes, x[~low], y[~low], depth - 1, least, rng)
            nodes[own] = (best[1], best[2], left, right, nodes[own][4])
        return own

    def score(self, x: np.ndarray) -> np.ndarray:
        """Mean share of secrets over the trees' leaves."""
        total = np.zeros(len(x))
        for column, limit, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(going := np.flatnonzero(column[at] >= 0)):
                node = at[going]
                at[going] = np.where(x[going, column[node]] <= limit[node], left[node], right[node])
            total += share[at]
        return total / len(self.trees)


def train(labelled: list[tuple[Finding, int]]) -> Forest:
    return Forest(np.array([measures(f) for f, _ in labelled]), np.array([y for _, y in labelled]))


@lru_cache(maxsize=1)
def default_forest() -> Forest:
    return train(examples())


def scored(text: str | None, forest: Forest, path: str | None = None) -> list[tuple[int, int, str, float]]:
    """(start, length, kind, score) of the candidates of a text. A private key block is a secret whatever the forest says."""
    found = list(findings(text, path))
    if not found:
        return []
    score = forest.score(np.array([measures(f) for _, f in found]))
    return [(start, len(f.text), f.kind, 1.0 if f.kind == "pem" else round(float(s), 6)) for (start, f), s in zip(found, score)]


def scan(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """One row per candidate: doc_id, start and length in characters, kind, score and `secret` (score of at least `least`).

    Null and empty texts have no candidates; null keys and paths and repeated rows are ordinary; further columns are ignored. Whole
    texts are scanned row by row; nothing is shuffled. The forest (about 0.1 MB) travels with the function."""
    model = forest or default_forest()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(doc, *hit, hit[3] >= least) for doc, t, p in zip(b["doc_id"], b["text"], b["path"]) for hit in scored(t, model, p)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "length", "kind", "score", "secret"]).astype({"doc_id": "Int64"})
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{path}`").cast("string").alias("path"))
    return rows.mapInPandas(run, "doc_id long, start long, length long, kind string, score double, secret boolean")


def redact(docs: DataFrame, forest: Forest | None = None, least: float = 0.5, text: str = "text", path: str = "source", chars: str = "n_chars") -> DataFrame:
    """docs with every secret in `text` replaced by MASK and `chars`, if there is such a column, set to the new length of changed texts.
    All rows and columns stay; texts without secrets, null ones included, stay as they are."""
    model = forest or default_forest()

    def clean(t: str | None, p: str | None) -> str | None:
        for start, length, _, score in reversed(scored(t, model, p)):
            if score >= least:
                t = t[:start] + MASK + t[start + length:]
        return t

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, paths: pd.Series) -> pd.Series:
        return pd.Series([clean(t, p) for t, p in zip(texts, paths)], dtype=object)
    after = docs.withColumn("__clean", cleaned(F.col(f"`{text}`"), F.col(f"`{path}`").cast("string")))
    same = F.col(f"`{text}`").eqNullSafe(F.col("__clean"))
    columns = [F.col("__clean").alias(c) if c == text else
               F.when(same, F.col(f"`{c}`")).otherwise(F.length("__clean")).cast(docs.schema[c].dataType).alias(c) if c == chars else F.col(f"`{c}`")
               for c in docs.columns]
    return after.select(*columns)


@query("op9_secret_forest")
def op9_secret_forest(spark: SparkSession, folder: str) -> DataFrame:
    """Candidates of all documents with their verdicts; tested by accuracy on held-out findings and by planted secrets."""
    return scan(table(spark, folder, "documents"))
