"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

Tokens are the pieces of a text between white space, quotes, brackets, commas and assignment signs, whatever their characters and length; an assignment sign is a
token too. The field tags every token of the whole text as secret begin, inside or outside. Its features are the token's shape, the two tokens before it and the one after it, whether it says the one before again, the
name before an assignment sign, and features of the whole file. A token that no path of Viterbi can gain by tagging begin or
inside (see Field.open()) is outside for certain; the stretches between such tokens are decoded, which gives the best tagging of the whole text.

The field is trained on this corpus, on at most `train_windows` windows of `WINDOW` tokens: around matches of the patterns, whose tokens are tagged begin and
inside; at random places; and around random credentials of other forms, of one token or of several, with or without digits, and random harmless codes, put into copies of the
texts. Features are left out at random. Spans of the patterns always stay; spans of the field that overlap none are added.

Null or empty text: no spans. Repeated rows: one row out for each. Empty table: no rows. Other columns are left out or, by
redact(), kept.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.llm.base import documents, table

#: The patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYWORDS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "crf")

#: A piece, with the equals signs that may end one; or a sign of assignment.
PIECE = re.compile(r"""[^\s"'`=:,;()<>\[\]{}|]+(?:=+(?=$|["'`,;)\]}]))?|[=:]""")
WORD = re.compile(r"\S+")
TURN = re.compile(r"[a-z][A-Z]")
#: What may end a piece without being part of it.
STOPS = ".!?"
SYMBOLS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
BEGIN, INSIDE, OUTSIDE = 0, 1, 2
WINDOW = 28
TRAIN_WINDOWS = 6000
TRAIN_DOCUMENTS = 2000
KEPT = 300_000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def pieces(text: str) -> list[tuple[int, int]]:
    """(start, end) of all tokens."""
    out = []
    for m in WORD.finditer(text):
        for x in PIECE.finditer(m[0]):
            core = x[0].rstrip(STOPS) or x[0]
            out.append((m.start() + x.start(), m.start() + x.start() + len(core)))
    return out


def file_features(text: str) -> tuple[str, ...]:
    b = text.encode("utf-8", "replace")
    n = max(1, len(b))
    share = lambda chars: (n - len(b.translate(None, chars))) / n
    return f"file:symbols={min(5, int(share(SYMBOLS) * 25))}", f"file:digits={min(5, int(share(b'0123456789') * 50))}", f"file:length={int(math.log2(n))}"


def plain(t: str) -> str | None:
    """The shape of a token of letters alone, or None."""
    if not t.isalpha():
        return None
    case = "a" if t.islower() else "Aa" if t[0].isupper() and t[1:].islower() else "A" if t.isupper() else f"aA{min(4, len(TURN.findall(t)))}/"
    return f"{case}{min(8, len(t) // 4)}{'' if t.isascii() else 'u'}"


def shape(t: str) -> list[str]:
    """Features of a token by itself."""
    if (form := plain(t)) is not None:
        return ["letters", f"form={form}"]
    n = len(t)
    kinds = "".join(k for k, r in (("a", r"[a-z]"), ("A", r"[A-Z]"), ("0", r"[0-9]"), ("+", r"[+/=]"), ("-", r"[_.-]"), ("!", r"[^A-Za-z0-9+/=_.-]")) if re.search(r, t))
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(t).values())
    digits = sum(map(t.count, "0123456789")) / n
    turns = len(re.findall(r"(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]", t)) / n
    return [
        "mixed",
        f"kinds={kinds}",
        f"length={min(10, n // 4)}",
        f"entropy={int(entropy * 2)}",
        f"digits={int(digits * 5)}",
        f"turns={int(turns * 8)}",
        f"shape={kinds}/{min(6, n // 8)}/{int(entropy)}",
        f"hex={bool(re.fullmatch(r'[0-9a-fA-F]+', t))}",
        f"numeric={bool(re.fullmatch(r'[0-9.+/_-]+', t))}",
        f"head={t[:4]}",
    ]


def identity(t: str) -> str:
    """A token as its neighbours see it: a word by itself, other tokens by their form."""
    return t.lower() if len(t) <= 20 and (t.isalpha() or t in "=:" or t.replace("_", "").replace("-", "").isalpha()) else "#" + (shape(t)[1] if len(t) < 200 else "")


def token_features(tokens: list[str], k: int) -> list[str]:
    own, ids = tokens[k], [identity(tokens[j]) if 0 <= j < len(tokens) else "" for j in (k - 1, k - 2, k + 1)]
    named = [f"name={ids[1]}"] if ids[0] in ("=", ":") else []
    again = ["again"] if k and tokens[k - 1] == own else []
    return [*shape(own), *again, f"w={identity(own)}", f"p1={ids[0]}", f"p2={ids[1]}", f"n1={ids[2]}", *named]


def tagged(tokens: list[tuple[int, int]], spans: list[tuple[int, int]]) -> list[int]:
    """Begin and inside for the tokens that overlap a span."""
    tags, inside = [], None
    for start, end in tokens:
        span = next((s for s in spans if s[0] < end and start < s[1]), None)
        tags.append(OUTSIDE if span is None else INSIDE if span == inside else BEGIN)
        inside = span
    return tags


#: Names that come before a credential, and how its characters are drawn: prefix, alphabet, least and most characters.
NAMES = ("password", "passphrase", "passcode", "pwd", "client_secret", "secret_key", "access_token", "auth_token", "authorization", "bearer", "credential", "credentials", "private_key", "access_key", "signing_key", "api key", "apikey", "session_key", "webhook_secret", "encryption_key")
PHRASES = ("passphrase", "recovery phrase", "seed phrase", "mnemonic", "backup codes", "private key")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
FORMS = (("", DIGITS + "ABCDEF", 24, 64), ("", UPPER + LOWER + DIGITS, 14, 40), ("", UPPER + LOWER + DIGITS + "+/", 24, 64), ("", LOWER + DIGITS, 8, 36), ("", UPPER + LOWER, 10, 32), ("", UPPER + LOWER + DIGITS + "!@#$%&*", 8, 24), ("ghp_", UPPER + LOWER + DIGITS, 36, 36), ("sk-", UPPER + LOWER + DIGITS, 32, 48), ("xoxb-", DIGITS + LOWER, 24, 48), ("eyJ", UPPER + LOWER + DIGITS + "_-", 40, 120), ("ASIA", UPPER + DIGITS, 16, 16))
#: Those at and after this place can stand without a name before them.
TELLING = 6
#: Harmless codes, 9 for any digit, x for any lower-case letter and X for any upper-case letter.
HARMLESS = ("999-9999", "999.999.999.999", "2099-99-99", "2099-99-99T99:99", "INV-2099-99999", "xxxxxx9", "xxxxxxxx99", "Xxxxxxx2099", "v9.99.9-xx9", "xxxxxx_2099_xxxxx.xxx", "www.xxxxxx9.xxx/xxxxx", "99999999", "999-9-99-999999-9", "9999999999", "9.9999999", "XX99-9999", "xxxxxxx-9999-xxxxx", "9999/9999", "Xxxxxxx-99", "xxx99xxxxxx", "+99999999999", "xxxxxxxx.xxxxx9.xxx", "xxxxx.xxxxxx@xxxxxxx.xxx", "xxxxxx99@xxxxx.xxx", "+99 999 9999999", "(999) 999-9999", "9999 9999 9999 9999", "https://xxxxxx.xxx/xxxx/9999", "#xxxxxx", "@xxxxxx99", "XXXXXXX", "xxxxXxxxxx")


def drawn(rng: random.Random, words: list[str]) -> tuple[str, int, int]:
    """A credential or a harmless code with what stands around it, and where the credential begins and ends (the same place if there is none). Credentials of several tokens are made of words, or of groups."""
    draw = lambda alphabet, n: "".join(rng.choices(alphabet, k=n))
    kind = rng.random()
    if kind < 0.35:
        if words and rng.random() < 0.1:
            return " ".join([rng.choice(words)] * rng.randint(8, 24) + [rng.choice(words)] * rng.randint(8, 24)), 0, 0  # words said over and over are no phrase
        code = "".join(rng.choice({"9": DIGITS, "x": LOWER, "X": UPPER}.get(c, c)) for c in rng.choice(HARMLESS))
        return rng.choice(["", "", "no. ", "id: ", "see ", "= ", "call: "]) + code, 0, 0
    name = rng.choice(PHRASES if kind > 0.8 else NAMES)
    name = rng.choice([name, name.upper(), name.capitalize()]) + rng.choice(["=", " = ", ": ", ":", ": ", " is ", " "])
    quote = rng.choice(["", '"', "'"])
    if kind > 0.8:
        n = rng.randint(3, 12)
        parts = [rng.choice(words).lower() for _ in range(n)] if rng.random() < 0.5 and words else [draw(rng.choice([DIGITS + LOWER, DIGITS + UPPER, UPPER + LOWER + DIGITS]), rng.choice([4, 5, 6, 8])) for _ in range(n)]
        quote = quote or '"' if parts[0].isalpha() else quote  # a phrase of words ends at its quote
        secret = " ".join(parts)
    else:
        k = rng.randrange(len(FORMS))
        prefix, alphabet, least, most = FORMS[k]
        secret = prefix + draw(alphabet, rng.randint(least, most))
        if k >= TELLING and rng.random() < 0.5:
            name = ""
    start = len(name) + len(quote)
    return f"{name}{quote}{secret}{quote}", start, start + len(secret)


def windows(doc_id: int | None, text: str) -> list[tuple[list[str], list[int], tuple[str, ...]]]:
    """Tokens, tags and file features around each match of the patterns, at a random place, and around a drawn code in each of three copies of the text."""
    rng = random.Random(f"{doc_id}/{len(text)}")
    out = []

    def cut(text: str, at: int, spans: list[tuple[int, int]]) -> None:
        tokens = pieces(text[max(0, at - 400) : at + 600])
        base = max(0, at - 400)
        k = next((i for i, (s, _) in enumerate(tokens) if s + base >= at), len(tokens))
        lo = max(0, k - rng.randint(4, WINDOW // 2))
        own = [(s + base, e + base) for s, e in tokens[lo : lo + WINDOW]]
        if own:
            out.append(([text[s:e] for s, e in own], tagged(own, spans), file_features(text)))

    base = [(s, e) for s, _, e in base_spans(text)]
    for s, _ in base[:4]:
        cut(text, s, base)
    spaces = [m.start() for m in re.finditer(r"\s", text)] or [len(text)]
    cut(text, rng.choice(spaces), base)
    for _ in range(3):
        at = rng.choice(spaces)
        code, s, e = drawn(rng, [w for w in text[max(0, at - 2000) : at].split() if w.isalpha()])
        copy = f"{text[:at]} {code} {text[at:]}"
        cut(copy, at + 1, [(s, e) for s, _, e in base_spans(copy)] + [(at + 1 + s, at + 1 + e)] * (e > s))
    return out


class Field:
    """Weights of features by tag, and of one tag after another. Chains begin and end with an outside token."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], follow: list[list[float]]):
        self.weights, self.follow = weights, follow

    def emission(self, feats: list[str]) -> list[float]:
        rows = [w for f in feats if (w := self.weights.get(f))]
        return [sum(r[k] for r in rows) for k in range(3)]

    def open(self, e: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Which tokens may be begin or inside; e: (tokens, 3) emissions of texts of these sizes, one after the other.

        A stretch of such tokens in the best path gains over the same stretch outside, which would be a path too. What a stretch gains is at
        most the sum of what its tokens and the transitions gain, so a token that is in no stretch with such a sum of 0 or more is outside for certain.
        """
        f = self.follow
        step = max(f[BEGIN][BEGIN], f[BEGIN][INSIDE], f[INSIDE][BEGIN], f[INSIDE][INSIDE]) - f[OUTSIDE][OUTSIDE]
        ends = f[OUTSIDE][BEGIN] + max(f[BEGIN][OUTSIDE], f[INSIDE][OUTSIDE]) - 2 * f[OUTSIDE][OUTSIDE]
        gain = np.maximum(e[:, BEGIN], e[:, INSIDE]) - e[:, OUTSIDE] + step
        starts = np.cumsum(sizes) - sizes
        u = np.insert(gain, starts, -1e6)  # no stretch goes over the border of two texts
        own = np.arange(len(gain)) + 1 + np.repeat(np.arange(len(sizes)), sizes)

        def best(u: np.ndarray) -> np.ndarray:
            """The largest sum of a stretch that ends here."""
            s = np.cumsum(u)
            return s - np.minimum.accumulate(np.append(0, s[:-1])) if len(s) else s

        return (best(u) + best(u[::-1])[::-1] - u)[own] >= step - ends - 1e-6

    def viterbi(self, e: list[list[float]]) -> list[int]:
        """The best tags of a chain between outside tokens, by its emissions."""
        f = self.follow
        scores = [f[OUTSIDE][j] + e[0][j] for j in range(3)]
        back = []
        for own in e[1:]:
            best = [max(range(3), key=lambda i, j=j: scores[i] + f[i][j]) for j in range(3)]
            scores = [scores[i] + f[i][j] + own[j] for j, i in enumerate(best)]
            back.append(best)
        tag = max(range(3), key=lambda j: scores[j] + f[j][OUTSIDE])
        tags = [tag]
        for best in reversed(back):
            tags.append(tag := best[tag])
        return tags[::-1]


NEVER = -1e4


def train(data: list[tuple[list[str], list[int], tuple[str, ...]]], rounds: int = 150, batch: int = 800, left_out: float = 0.25, decay: float = 2e-5, seed: int = 7) -> Field:
    """Conditional log-likelihood by a running-average gradient; expectations by forward-backward over a batch of windows at a time."""
    rng = np.random.default_rng(seed)
    feats = [[[*token_features(t, k), *files] for k in range(len(t))] for t, _, files in data]
    seen = Counter(f for own_chain in feats for own in own_chain for f in own)
    index = {f: k + 1 for k, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    width = max((len(own) for own_chain in feats for own in own_chain), default=1)
    n = max((len(c) for c in feats), default=1)
    idx, tags, real = np.zeros((len(data), n, width), np.int32), np.full((len(data), n), OUTSIDE), np.zeros((len(data), n), dtype=bool)
    for i, (own_chain, (_, own, _)) in enumerate(zip(feats, data, strict=True)):
        real[i, : len(own)], tags[i, : len(own)] = True, own
        for k, x in enumerate(own_chain):
            idx[i, k, : len(x)] = [index.get(f, 0) for f in x]
    del feats
    w, follow = np.zeros((len(index) + 1, 3)), np.zeros((3, 3))
    follow[OUTSIDE, INSIDE] = NEVER
    legal = np.where(follow > NEVER, 1.0, 0.0)
    m, v = [np.zeros_like(w), np.zeros((3, 3))], [np.zeros_like(w), np.zeros((3, 3))]
    one = np.eye(3)
    for t in range(1, rounds + 1):
        if not len(data):
            break
        k = rng.permutation(len(data))[:batch]
        own = np.where(rng.random(idx[k].shape) < left_out, 0, idx[k])
        e = w[own].sum(2)
        e[~real[k]] = [NEVER, NEVER, 0]  # after its end a chain is outside
        a, b = [follow[OUTSIDE] + e[:, 0]], [np.broadcast_to(follow[:, OUTSIDE], (len(k), 3))]
        for i in range(1, n):
            a.append(e[:, i] + np.logaddexp.reduce(a[-1][:, :, None] + follow, axis=1))
        for i in range(n - 1, 0, -1):
            b.append(np.logaddexp.reduce(follow + (e[:, i] + b[-1])[:, None, :], axis=2))
        b = b[::-1]
        z = np.logaddexp.reduce(a[-1] + b[-1], axis=1)
        total = real[k].sum()
        d = (one[tags[k]] - np.exp(np.stack(a, 1) + np.stack(b, 1) - z[:, None, None])) * real[k][:, :, None] / total
        dw = np.stack([np.bincount(own.ravel(), weights=np.repeat(d[:, :, c].ravel(), width), minlength=len(w)) for c in range(3)], 1) - decay * w
        dw[0] = 0
        df = -decay * follow * legal
        before = np.full(len(k), OUTSIDE)
        prior = np.tile(np.where(np.arange(3) == OUTSIDE, 0.0, NEVER), (len(k), 1))
        for i in range(n + 1):
            now, to = (tags[k][:, i], e[:, i] + b[i]) if i < n else (np.full(len(k), OUTSIDE), np.tile(np.where(np.arange(3) == OUTSIDE, 0.0, NEVER), (len(k), 1)))
            p = np.exp(np.minimum(prior[:, :, None] + follow + to[:, None, :] - z[:, None, None], 0))
            df += (one[before][:, :, None] * one[now][:, None, :] - p).sum(0) / total
            before, prior = now, a[i] if i < n else prior
        for x, g, mean, square in ((w, dw, m[0], v[0]), (follow, df * legal, m[1], v[1])):
            mean *= 0.9
            mean += 0.1 * g
            square *= 0.99
            square += 0.01 * g**2
            x += 0.15 * min(1, 2 * (1 - t / (rounds + 1))) * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    return Field({f: tuple(map(float, w[k])) for f, k in index.items() if np.abs(w[k]).max() > 1e-3}, follow.tolist())


def fit(docs: DataFrame, train_documents: int = TRAIN_DOCUMENTS, train_windows: int = TRAIN_WINDOWS) -> Field:
    """Trained on windows of about train_documents documents, chosen by a hash of their id and text, and on train_windows at most."""
    rows = documents(docs)
    every = max(1, math.ceil(rows.count() / train_documents))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            yield pd.DataFrame([(d, *w) for d, text in zip(pdf["doc_id"], pdf["text"], strict=True) for w in windows(d, text)], columns=["doc_id", "tokens", "tags", "files"])

    sample = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0).mapInPandas(run, "doc_id long, tokens array<string>, tags array<int>, files array<string>")
    got = sample.orderBy(F.xxhash64("doc_id", "tokens"), "doc_id").limit(train_windows).collect()
    return train([(r["tokens"], list(r["tags"]), tuple(r["files"])) for r in got])


class Tokens:
    """Rows of weights for words and their tokens, each looked up once and kept while it is among the `KEPT` words met last. Tokens with the same features share a row; row 0 stands before and after a text."""

    PLACES = ("w", "p1", "p2", "n1", "name")

    def __init__(self, field: Field):
        self.field = field
        self.files: dict[tuple[str, ...], list[float]] = {}
        #: For each identity its weights as the token itself, as the first and the second before another, as the one after, and as a name; those of tokens' forms.
        self.identities: dict[str, list[float]] = {}
        for name, w in field.weights.items():
            place, _, value = name.partition("=")
            if place in self.PLACES:
                k = self.PLACES.index(place) * 3
                self.identities.setdefault(value, [0.0] * 15)[k : k + 3] = w
        self.clear()

    def clear(self) -> None:
        first = [0.0] * 3 + self.identities.get("", [0.0] * 15)[3:]
        #: The rows' three numbers for each place, rows that were added since, and whether a row is of a sign that a name stands before.
        self.rows = [np.array([first[k : k + 3]]) for k in range(0, 15, 3)]
        self.sign, self.added, self.known = np.zeros(1, dtype=bool), [], {}
        #: Of each word its tokens' rows, and numbers by which equal tokens are told: of the words met lately, and of those met before them.
        self.words: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}
        self.before: dict[str, tuple[tuple[int, ...], tuple[int, ...]]] = {}

    def row(self, key: tuple, own: list[str], name: str) -> int:
        if (k := self.known.get(key)) is None:
            k = self.known[key] = len(self.sign) + len(self.added)
            row = list(self.identities.get(name, [0.0] * 15))
            row[:3] = [a + b for a, b in zip(row[:3], self.field.emission(own), strict=True)]
            self.added.append((row, name in ("=", ":")))
        return k

    def token(self, t: str) -> int:
        if len(t) <= 20 and (form := plain(t)) is not None:
            name = t.lower()
            name = name if name in self.identities else None
            return self.row((form, name), ["letters", f"form={form}"], name)
        own, name = shape(t), identity(t)
        return self.row((*own, name), own, name)

    def word(self, w: str) -> tuple[tuple[int, ...], tuple[int, ...]]:
        core = w.rstrip(STOPS)
        own = [core] if core.isalpha() else [x.rstrip(STOPS) or x for x in PIECE.findall(w)]
        return tuple([self.token(x) for x in own]), tuple([hash(x) for x in own])

    def emissions(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, 3) of all texts, one after the other, and how many tokens each has."""
        if len(self.sign) > KEPT // 4:
            self.clear()
        elif len(self.words) > KEPT // 2:  # words that aren't met again soon go, frequent ones stay
            self.words, self.before = {}, self.words
        split = [t.split() for t in texts]
        every = [w for x in split for w in x]
        got = list(map(self.words.get, every))
        if None in got:
            for w in set(every):
                if w not in self.words:
                    self.words[w] = self.before.pop(w, None) or self.word(w)
            got = list(map(self.words.__getitem__, every))
        if self.added:
            new = np.array([row for row, _ in self.added])
            self.rows = [np.vstack([x, new[:, 3 * k : 3 * k + 3]]) for k, x in enumerate(self.rows)]
            self.sign = np.append(self.sign, [x for _, x in self.added])
            self.added = []
        (own, p1, p2, n1, name), sign = self.rows, self.sign
        n = np.fromiter([len(x) for x, _ in got], np.int64, len(got))
        flat = np.fromiter(chain.from_iterable([x for x, _ in got]), np.int64, int(n.sum()))
        told = np.fromiter(chain.from_iterable([x for _, x in got]), np.int64, len(flat))
        of_word = np.repeat(np.arange(len(texts)), [len(x) for x in split])
        of = np.repeat(of_word, n)
        sizes = np.bincount(of, minlength=len(texts))
        padded = np.zeros(len(flat) + 2 * len(texts) + 2, dtype=np.int64)
        at = np.arange(len(flat)) + 2 * (of + 1)  # two rows stand before each text, and two after the last
        padded[at] = flat
        e = own[flat] + p1[padded[at - 1]] + p2[padded[at - 2]] + n1[padded[at + 1]]
        after = sign[padded[at - 1]]
        e[after] += name[padded[at[after] - 2]]
        again = np.flatnonzero(told[1:] == told[:-1]) + 1
        e[again[of[again] == of[again - 1]]] += self.field.weights.get("again", (0.0, 0.0, 0.0))
        files = np.array([self.files.setdefault(f, self.field.emission(list(f))) for f in map(file_features, texts)]).reshape(-1, 3)
        return e + files[of], sizes

    def found(self, texts: list[str]) -> list[list[tuple[int, int]]]:
        """Each text's spans by the field: from each begin to the last inside."""
        e, sizes = self.emissions(texts)
        out: list[list[tuple[int, int]]] = [[] for _ in texts]
        starts = np.cumsum(sizes) - sizes
        at = np.flatnonzero(self.field.open(e, sizes))
        of = np.searchsorted(np.cumsum(sizes), at, side="right")
        for d in np.unique(of).tolist():
            own = at[of == d]
            tags = np.full(sizes[d], OUTSIDE)
            for run in np.split(own, np.flatnonzero(np.diff(own) > 1) + 1):
                tags[run - starts[d]] = self.field.viterbi(e[run].tolist())
            if (tags == OUTSIDE).all():
                continue
            tokens = pieces(texts[d])
            for k in np.flatnonzero(tags != OUTSIDE).tolist():
                if tags[k] == BEGIN:
                    out[d].append(tokens[k])
                else:
                    out[d][-1] = (out[d][-1][0], tokens[k][1])
        return out


def said_over(text: str, start: int, end: int) -> bool:
    """Whether a span is one word said over and over: three times or more, or again directly before or after it. No credential reads so."""
    own = text[start:end].split()
    if len(set(own)) != 1:
        return False
    reach = len(own[0]) + 16
    before, after = text[max(0, start - reach) : start].split()[-1:], text[end : end + reach].split()[:1]
    return len(own) > 2 or own[:1] in (before, after)


def added(text: str, spans: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The field's spans that overlap none of base, without words said over and over."""
    return [(s, 3, e) for s, e in spans if not any(b[0] < e and s < b[2] for b in base) and not said_over(text, s, e)]


def added_spans(text: str, field: Field, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    return added(text, Tokens(field).found([text])[0], base)


_worker: dict[str, Tokens] = {}


def worker_tokens(key: str, field: Field) -> Tokens:
    """One for each Python worker and field."""
    if key not in _worker:
        _worker.clear()
        _worker[key] = Tokens(field)
    return _worker[key]


def all_spans(texts: list[str], tokens: Tokens, step: int = 128) -> Iterator[tuple[list, list]]:
    """For each text the patterns' spans and those the field adds."""
    for k in range(0, len(texts), step):
        part = texts[k : k + step]
        for text, spans in zip(part, tokens.found(part), strict=True):
            base = base_spans(text)
            yield base, added(text, spans, base)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base (the patterns' spans, joined), spans (all, joined): code points, end exclusive."""
    key = uuid.uuid4().hex

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for d, (base, more) in zip(pdf["doc_id"], all_spans(pdf["text"].tolist(), worker_tokens(key, field)), strict=True):
                kinds = [k for _, k, _ in base]
                out.append((d, kinds.count(0), kinds.count(1), kinds.count(2), len(more), joined(base), joined(base + more)))
            yield pd.DataFrame(out, columns=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base", "spans"])

    return documents(docs).mapInPandas(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base string, spans string")


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for s, _, e in sorted(spans):
        if e > at:
            if s >= at:
                out += [text[at:s], mask]
            at = e
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field, mask: str = "[secret]") -> DataFrame:
    """docs with every secret span of text replaced by mask; null texts stay null. Where docs has n_chars, it is counted anew."""
    key = uuid.uuid4().hex

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            spans = all_spans([t or "" for t in s], worker_tokens(key, field))
            yield pd.Series([None if t is None else masked(t, base + more, mask) for t, (base, more) in zip(s, spans, strict=True)], dtype=object)

    text = F.pandas_udf(run, "string")("text")
    out = docs.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def op1_secret_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scan(docs, fit(docs))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_crf")
