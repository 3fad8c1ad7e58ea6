"""Secret scan: candidates by form, and a random forest that removes false positives.

Candidates are long runs of key characters and the values that secret-like
names are set to. The forest looks at a candidate's length, character classes
and transitions, how much of it dictionary words cover, the path, and the words
before and after it. The dictionary is the corpus' own frequent words.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pedon.llm import textkit as tk
from pedon.llm.forest import Forest
from pedon.llm.graph import durable

#: Shortest run of key characters that is a candidate by itself.
LONG = 20
#: Relative frequency that makes a word of three letters or more a dictionary word; at most 1 / FREQUENT words.
FREQUENT = 2e-5
THRESHOLD = 0.5
_RUN = np.zeros(256, bool)
_RUN[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *b"+/_=-."]] = True
_LETTERS = np.zeros(256, bool)
_LETTERS[0x61:0x7B] = True
_LETTERS[0x80:] = True
NAMED = re.compile(rb"(?i)(?:token|secret|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|auth[a-z_-]*|credentials?|private[_-]?key)[\"' ]{0,3}$")
VALUE = re.compile(rb"[=:>]{0,2}\s{0,3}[\"']?((?:(?!&[\w.-]+=)[^\s\"'<>,;]){6,})")
#: Published forms of keys (fixed values), searched for inside runs.
FORMS = [
    ("aws_access_key", re.compile(rb"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("github_token", re.compile(rb"(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36,}")),
    ("gitlab_token", re.compile(rb"(?<![A-Za-z0-9])glpat-[A-Za-z0-9_-]{20,}")),
    ("slack_token", re.compile(rb"(?<![A-Za-z0-9])xox[abprs]-[A-Za-z0-9-]{10,}")),
    ("google_api_key", re.compile(rb"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
    ("stripe_key", re.compile(rb"(?<![A-Za-z0-9])[rs]k_live_[0-9A-Za-z]{24,}")),
    ("json_web_token", re.compile(rb"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*")),
]
_KEY = b"-----BEGIN "
#: A private key's first line, and its header and base64 lines.
_BODY = re.compile(rb"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:\s+[A-Za-z-]+: [^\r\n]+)*(?:\s+[A-Za-z0-9+/]{40,}={0,2})*(?:\r?\n[ \t]*[A-Za-z0-9+/]{2,}={0,2}(?=[ \t]*(?:[\r\n]|$)))?")
_PART = re.compile(rb"[^=]+=*")
FOR = [b"token", b"secret", b"password", b"passwd", b"pwd", b"key", b"auth", b"bearer", b"credential", b"passphrase", b"apikey"]
AGAINST = [b"sha", b"md5", b"hash", b"commit", b"digest", b"checksum", b"uuid", b"guid", b"revision", b"integrity", b"example", b"placeholder", b"sample", b"etag", b"build", b"url", b"http", b"path"]
_whole = lambda words: re.compile(rb"(?<![a-z])(?:" + b"|".join(words) + rb")s?(?![a-z])")
_FOR, _AGAINST = _whole(FOR), _whole(AGAINST)
GOOD_PATH, BAD_PATH = re.compile(r"(?i)config|\.env|credential|secret|settings|deploy|\.pem|\.key"), re.compile(r"(?i)test|example|fixture|sample|mock|doc|\.lock|vendor")


def candidates(raw: bytes, data: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each candidate in a text, in order, without overlaps.

    Private keys go before known forms, these before named values and these
    before long runs, which end at "=" unless it closes them; what a better
    kind leaves of a candidate is a long run if it is long enough.
    """
    keys, forms, named, runs = [], [], [], []
    s, e, _ = tk.words(data, np.array([0, len(data)]), _RUN)
    for a, b in zip(*(x[e - s >= LONG].tolist() for x in (s, e)), strict=True):
        run = raw[a:b]
        forms += [(a + m.start(), a + m.end(), kind) for kind, p in FORMS for m in p.finditer(run)]
        for m in _PART.finditer(run):
            runs.append((a + m.start(), a + (m.end() if m.end() == len(run) else m.start() + len(m[0].rstrip(b"="))), "long_run"))
    for i in np.flatnonzero((data == 0x3D) | (data == 0x3A)).tolist():
        if NAMED.search(raw[max(0, i - 40) : i]) and (m := VALUE.match(raw, i)):
            named.append((*m.span(1), "named_value"))
    i = raw.find(_KEY)
    while i >= 0:
        after = raw.find(_KEY, i + 1)
        if b"PRIVATE KEY-----" in raw[i : i + 60]:
            j = raw.find(b"-----END ", i, after if after >= 0 else len(raw))
            m = _BODY.match(raw, i)
            keys.append((i, j if j > 0 else m.end() if m else min(len(raw), i + 64), "private_key"))
        i = after
    out: list[tuple[int, int, str]] = []
    for found in (keys, sorted(forms), sorted(named), runs):
        for a, b, kind in found:
            at = bisect.bisect_right(out, a, key=lambda x: x[1])
            free, whole = [], a
            while at < len(out) and out[at][0] < b:
                free.append((whole, out[at][0]))
                whole, at = out[at][1], at + 1
            free.append((whole, b))
            alone = len(free) == 1
            for c, d in free:
                if kind == "long_run" or not alone:
                    c += len(raw[c:d]) - len(raw[c:d].lstrip(b"=.-"))
                    d -= len(raw[c:d]) - len(raw[c:d].rstrip(b".-"))
                    if d - c < LONG:
                        continue
                bisect.insort(out, (c, d, kind if alone else "long_run"))
    return out


@dataclass
class Detector:
    words: np.ndarray  # sorted hashes of dictionary words
    transition: np.ndarray  # log odds of two successive bytes, secret against not
    forest: Forest

    def features(self, values: list[bytes], before: list[bytes], after: list[bytes], paths: list[str], kinds: list[str]) -> np.ndarray:
        rows = []
        for v, left, right, path, kind in zip(values, before, after, paths, kinds, strict=True):
            b = np.frombuffer(v, np.uint8)
            n = len(b)
            counts = np.bincount(b, minlength=256)
            p = counts[counts > 0] / n
            cls = np.select([(b >= 48) & (b < 58), (b >= 65) & (b < 91), (b >= 97) & (b < 123)], [0, 1, 2], 3)
            left, right = left.lower(), right.lower()
            rows.append(
                [
                    n,
                    -(p * np.log2(p)).sum(),
                    len(p) / n,
                    *(float((cls == k).mean()) for k in range(4)),
                    float((cls[1:] != cls[:-1]).mean()) if n > 1 else 0.0,
                    float(self.transition[b[:-1], b[1:]].mean()) if n > 1 else 0.0,
                    self.coverage(v),
                    *(min([len(left) - m.start() for m in words.finditer(left)], default=99) for words in (_FOR, _AGAINST)),
                    *(m.start() if (m := words.search(right)) else 99 for words in (_FOR, _AGAINST)),
                    float(bool(GOOD_PATH.search(path))) - float(bool(BAD_PATH.search(path))),
                    float(kind not in ("long_run", "named_value")),
                    float(kind == "named_value"),
                    float(b"=" in left[-4:] or b":" in left[-4:]),
                ]
            )
        return np.array(rows, float).reshape(len(rows), 18)

    def coverage(self, value: bytes) -> float:
        """Share of a value's bytes inside dictionary words of 3 to 12 letters."""
        data = tk.FOLD[np.frombuffer(value, np.uint8)]
        n = len(data)
        if not len(self.words) or n < 3:
            return 0.0
        inside = np.zeros(n + 1, np.int64)
        for k in range(3, 13):
            for i in range(0, n - k + 1, 1 << 16):
                at = np.arange(i, min(i + (1 << 16), n - k + 1))
                h = tk.span_hashes(data, at, at + k)
                at = at[self.words[np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)] == h]
                inside[at] += 1
                inside[at + k] -= 1
        return float((np.cumsum(inside)[:n] > 0).mean())


def labelled_findings(n: int = 5000, seed: int = 3) -> pd.DataFrame:
    """(value, before, after, path, kind, label): made-up findings of the usual sorts, half of them secrets.

    Neither the form nor the words around it decide alone: a share of the
    secrets stands in prose or behind a word that speaks against one, and a
    share of the rest, digests and placeholders among them, behind the name of
    a secret.
    """
    rng = np.random.default_rng(seed)
    hexa, b62 = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    b64, upper = b62 + "+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    draw = lambda alphabet, k: "".join(rng.choice(list(alphabet), k))
    pick = lambda *xs: xs[rng.integers(len(xs))]
    syllables = "an er in on re en th ti es or te ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(2, 5)))
    secret_path, other_path = ["src/config.py", ".env", "deploy/settings.yml", "app/main.py", ""], ["tests/fixtures/a.json", "docs/usage.md", "package.lock", "app/main.py", ""]
    out = []
    for i in range(n):
        if i % 2:
            kind, value = pick(
                *[("named_value", draw(hexa, pick(32, 40, 64)))] * 3,
                ("named_value", draw(b62, int(rng.integers(16, 48)))),
                ("named_value", draw(b64, 40)),
                ("named_value", draw(hexa.upper(), 40)),
                ("aws_access_key", "AKIA" + draw(upper, 16)),
                ("github_token", "ghp_" + draw(b62, 36)),
                ("google_api_key", "AIza" + draw(b62 + "_-", 35)),
                ("slack_token", "xoxb-" + draw("0123456789", 12) + "-" + draw(b62, 24)),
                ("long_run", draw(b62, int(rng.integers(24, 64)))),
                ("named_value", pick("Xk7!", "qP9$", "zR4#") + draw(b62 + "!#%", 10)),
            )
            name = pick("token", "secret", "api_key", "password", "access_key", "auth_token")
            name = pick(name, name.upper(), name + "_" + word())
            before = f"{word()} {pick(word(), word(), 'example.com', 'path')} {name} {pick('=', ':')} " + pick('"', "", "'")
            if kind == "long_run" or rng.random() < 0.1:  # bare, in prose or behind another word
                before, kind = f"{word()} {pick(word(), 'id', 'build', 'url', 'the key is', 'use')} ", "long_run" if kind == "named_value" and len(value) >= LONG else kind
            after = pick(*[f"{pick(chr(34), '', ',')} {word()} {word()}"] * 4, " # do not commit", " keep this secret", " for the example", " login password")
            out.append((value, before, after, pick(*secret_path, *other_path[-2:]), kind, 1))
        else:
            placeholder = False
            digest = rng.random() < 0.3
            if digest:
                value = draw(hexa, pick(32, 40, 64))
            else:
                value = pick(
                    lambda: "-".join(draw(hexa, k) for k in (8, 4, 4, 4, 12)),
                    lambda: "".join(word() for _ in range(int(rng.integers(3, 9)))),
                    lambda: "-".join(word() for _ in range(int(rng.integers(3, 6)))),
                    lambda: "/".join(word() for _ in range(int(rng.integers(3, 6)))) + pick(".html", ".py", ""),
                    lambda: pick("x", "*", "0", "-", "=") * int(rng.integers(20, 60)),
                    lambda: pick("your_token_here", "changeme", "replace-with-your-key", "example_password", "None", "os.environ", "getpass.getpass()", "undefined"),
                    lambda: draw("0123456789", int(rng.integers(20, 30))),
                    lambda: "_".join(word() for _ in range(int(rng.integers(3, 6)))),
                )()
                placeholder = len(value) < LONG or rng.random() < 0.3
            kind = "named_value" if placeholder else "long_run"
            if digest:  # some behind the name of a secret too, with the word for a digest on either side
                of, secret = pick("sha256", "commit", "md5", "checksum", "hash", "digest"), pick("token", "key", "secret")
                named = rng.random() < 0.3
                kind = "named_value" if named else kind
                before = pick(f"{of} of the {secret}: ", f"{secret} {of} = ") if named else f"{word()} {of}{pick('=', ':', ' ')}"
                after = pick(f" {word()} {word()}", f" ({of})", f" is the {of} of the {secret}")
            else:
                name = pick("token", "password", "secret", "api_key") if placeholder else word()
                before = f"{word()} {name}{pick('=', ':', ' = ') if placeholder else ' '}" + pick('"', "")
                after = pick(f" {word()} {word()}", f" {word()} token", " as an example", "")
            out.append((value, before, after, pick(*other_path, *secret_path[-2:]), kind, 0))
    return pd.DataFrame(out, columns=["value", "before", "after", "path", "kind", "label"])


def train(findings: pd.DataFrame, words: np.ndarray) -> Detector:
    values = [v.encode() for v in findings["value"]]
    counts = np.full((2, 256, 256), 0.1)
    for v, y in zip(values, findings["label"], strict=True):
        b = np.frombuffer(v, np.uint8)
        np.add.at(counts[int(y)], (b[:-1], b[1:]), 1)
    p = counts / counts.sum(axis=2, keepdims=True)
    found = Detector(words, np.log(p[1] / p[0]), Forest())
    around = [[b.encode() for b in findings[c]] for c in ("before", "after")]
    x = found.features(values, *around, list(findings["path"]), list(findings["kind"]))
    found.forest.fit(x, findings["label"].to_numpy(float))
    return found


def dictionary(docs: DataFrame, text_col: str = "text", frequent: float = FREQUENT) -> np.ndarray:
    """Sorted hashes of the words of three letters or more whose share of all words is ``frequent`` at least."""

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text", 4 << 20):
                data, offs = tk.buffers(part.column(0))
                data = tk.FOLD[data]
                s, e, _ = tk.words(data, offs, _LETTERS)
                fit = (e - s >= 3) & (e - s <= 12)
                h, c = np.unique(tk.span_hashes(data, s[fit], e[fit]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], names=["word", "c"])

    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))
    counts = durable(counts)
    total = counts.agg(F.sum("c")).first()[0] or 0
    got = counts.where(F.col("c") >= total * frequent).select("word").toPandas()
    return np.sort(got["word"].to_numpy(np.int64).view(np.uint64))


def secret_scan(docs: DataFrame, findings: pd.DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per candidate: (id_col, start, length, kind, value_sha256, probability, is_secret).

    start and length count bytes of the UTF-8 text. ``findings`` (value,
    before, after, path, kind, label) are labelled findings; made-up ones serve
    otherwise. Texts that are null, empty or without candidates have no rows;
    rows that repeat have theirs again. A null path is empty.
    """
    model = train(labelled_findings() if findings is None else findings, dictionary(docs, text_col))
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for _, part in tk.row_slices(batch, "text"):
                data, offs = tk.buffers(part.column(1))
                paths = part.column(2).to_pylist()
                row, start, size, kinds, values, before, after = [], [], [], [], [], [], []
                for r in range(part.num_rows):
                    own = data[offs[r] : offs[r + 1]]
                    raw = own.tobytes()
                    for a, b, kind in candidates(raw, own):
                        row.append(r)
                        start.append(a)
                        size.append(b - a)
                        kinds.append(kind)
                        values.append(raw[a:b])
                        before.append(raw[max(0, a - 40) : a])
                        after.append(raw[b : b + 40])
                p = held.value.forest.predict(held.value.features(values, before, after, [paths[r] or "" for r in row], kinds)) if row else np.zeros(0)
                p = np.maximum(p, [k == "private_key" for k in kinds]) if row else p
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(size, pa.int64()),
                        pa.array(kinds, pa.string()),
                        pa.array([hashlib.sha256(v).hexdigest() for v in values], pa.string()),
                        pa.array(p, pa.float64()),
                    ],
                    names=["id", "start", "length", "kind", "value_sha256", "probability"],
                )

    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), path.alias("path"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(run, f"id {kind}, start long, length long, kind string, value_sha256 string, probability double")
    return out.withColumnRenamed("id", id_col).withColumn("is_secret", F.col("probability") >= threshold)
