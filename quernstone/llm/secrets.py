"""Secret scans: fixed patterns, and character Markov models for what they miss."""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm.common import buffer, in_arrow, ranges, slices, table, words

#: On lowered text, where the value's letters are lowered too.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "markov")
LEAST = {"assign": 12, "access": 18, "hex": 16, "markov": 20}

SYMBOLS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
START = len(SYMBOLS)
N = START + 1
#: Symbol of each byte; START for bytes that no token has.
CODE = np.full(256, START, np.int64)
CODE[list(SYMBOLS)] = np.arange(START)
NO_TOKEN = CODE == START
HEX = np.zeros(256, bool)
HEX[list(b"0123456789abcdef")] = True


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a slice with a line feed, which no pattern takes, after each."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 10, np.uint8)
    keep = np.ones(len(out), bool)
    keep[offsets[1:] + np.arange(n)] = False
    out[keep] = data
    return out, offsets + np.arange(n + 1)


def base_spans(data: np.ndarray) -> dict[str, list[tuple[int, int]]]:
    """Byte spans by kind: leftmost and non-overlapping per kind, then those long enough."""
    raw = data.tobytes()
    inside = np.concatenate([[False], HEX[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    s, e = edge[::2], edge[1::2]
    long = e - s >= LEAST["hex"]
    return {
        "assign": [m.span() for m in ASSIGN.finditer(raw.lower()) if m.end(2) - m.start(2) >= LEAST["assign"]],
        "access": [m.span() for m in ACCESS.finditer(raw) if m.end() - m.start() >= LEAST["access"]],
        "hex": list(zip(s[long].tolist(), e[long].tolist(), strict=True)),
    }


def steps(data: np.ndarray) -> np.ndarray:
    """The transition into each byte: (two symbols before, symbol). Before a token: START."""
    c = CODE[data]
    one = np.concatenate([[START], c[:-1]])
    two = np.concatenate([[START], one[:-1]])
    two[one == START] = START
    return (two * N + one) * N + c


def tokens(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, _ = words(data, np.array([0, len(data)]), NO_TOKEN)
    return s, e


#: A long token is an ordinary identifier if so few of its bytes are digits or change from a
#: letter of one case to one of the other.
BROKEN = 0.1


def broken(data: np.ndarray) -> np.ndarray:
    """Bytes that are digits, or letters of another case than the letter before."""
    digit = (data >= 48) & (data <= 57)
    lower, upper = (data >= 97) & (data <= 122), (data >= 65) & (data <= 90)
    out = digit.copy()
    out[1:] |= lower[:-1] & upper[1:]
    return out


class Counts:
    """Transitions of random strings (row 1) and of ordinary identifiers (row 0)."""

    def __init__(self):
        self.n = np.zeros((2, N**3), np.int64)

    def add(self, data: np.ndarray) -> None:
        """Labels a slice's tokens: those within a base span are secrets; elsewhere short ones
        are ordinary, and so are long ones that read like words put together, by BROKEN. Other
        long ones are what scan() judges, and have no label."""
        at, secret, base = steps(data), np.zeros(len(data), bool), base_spans(data)
        for spans in base.values():
            for s, e in spans:
                secret[s:e] = True
        real = CODE[data] != START
        s, e = tokens(data)
        breaks = np.concatenate([[0], np.cumsum(broken(data))])
        unsure = (e - s >= LEAST["markov"]) & (breaks[e] - breaks[s] > BROKEN * (e - s))
        unknown = ranges(s[unsure], (e - s)[unsure])
        real[unknown[~secret[unknown]]] = False
        # the key word of an assignment is ordinary: a secret is what follows the last separator
        for s, e in base["assign"]:
            m = ASSIGN.match(data[s:e].tobytes().lower())
            secret[s : s + m.start(2)] = False
        for label, where in ((0, real & ~secret), (1, real & secret)):
            self.n[label] += np.bincount(at[where], minlength=N**3)


def ratios(cells: list[tuple[int, int, int]], smooth: float = 0.5, back: float = 8.0) -> np.ndarray:
    """Log-likelihood ratio of each transition, random over ordinary, with additive smoothing.
    cells: (label, transition, count)."""
    n = np.zeros((2, N * N, N))
    for label, cell, count in cells:
        n[label, cell // N, cell % N] += count
    # a pair of symbols falls back on the last one, and that on how common a symbol is
    one = n.reshape(2, N, N, N).sum(axis=1)
    none = one.sum(axis=1, keepdims=True) + smooth
    none /= none.sum(axis=2, keepdims=True)
    one = (one + back * none) / (one.sum(axis=2, keepdims=True) + back)
    prior = np.tile(one[:, None], (1, N, 1, 1)).reshape(2, N * N, N)
    p = (n + back * prior) / (n.sum(axis=2, keepdims=True) + back)
    return (np.log(p[1]) - np.log(p[0])).ravel().astype(np.float32)


#: Words that ordinary samples are put together from.
WORDS = "access account address admin article backup batch block branch bucket build cache calendar center change channel client cluster comment commit company config content core country customer data default detail device document domain driver email error event example export feature field file filter folder format forum group guide header history home host image import index input item job kernel language layer library limit list local login manager map market member message method model module network news note object office option order output package page parser patch path people photo player plugin policy pool post process product profile project query queue record release report request resource result review route sample schema school script search section server service session setting share site source stage start state status storage stream string style support system table target task team template test text thread ticket time title topic trace train update upload user value version video view volume web widget window work world writer".split()
#: Every third word is kept from the model, and its margins are set by samples of these.
HELD = WORDS[::3]
#: Samples of each label that the model is taught, and others that its margins are set by.
TAUGHT, TRIED = 12000, 8000
#: Lengths from which a margin of its own holds, the share of ordinary samples of such a length
#: that it may let through, and the least margin, in nats.
LENGTHS, LET, LEAST_MARGIN = (20, 24, 32, 44), 0.005, 0.3
ALNUM = SYMBOLS[:62].decode()
ALPHABETS = (ALNUM, ALNUM + "+/", ALNUM + "-_", SYMBOLS[:52].decode(), SYMBOLS[26:62].decode(), SYMBOLS[:26].decode() + "0123456789")


#: Parts of syllables, for words that no list has.
ONSETS = "b bl br c ch cl cr d dr f fl fr g gl gr h j k kn l m n p ph pl pr ps qu r s sc sch sh sk sl sm sn sp st str sw t th tr tw v w wh wr x y z".split() + [""] * 9
NUCLEI = "a a a e e e i i i o o u u y ai au ea ee ei eu ia ie io oa oi oo ou ue ui".split()
CODAS = "b ck ct d f ff ft g h k l ll ld lf lk lm ls lt m mb mp n nc nd ng nk ns nt p pt r rb rc rd rk rl rm rn rp rs rt s sc sh sk sm sp ss st t th ts tt v w x xt z".split() + [""] * 30


def named(rng: random.Random, words: list[str]) -> str:
    """A word of the list, or one made of syllables, or a short form of a few letters."""
    kind = rng.random()
    if kind < 0.5:
        return rng.choice(words)
    if kind < 0.85:
        return "".join(rng.choice(p) for _ in range(rng.randrange(1, 4)) for p in (ONSETS, NUCLEI, CODAS))
    return "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randrange(2, 5)))


def ordinary(rng: random.Random, words: list[str]) -> str:
    """A long token of everyday use: a path, an address, names joined in one of the usual ways,
    with or without numbers, a UUID, a time or a numbered thing."""
    pick = lambda n: [named(rng, words) for _ in range(n)]
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    number = lambda: rng.choice(["", "", digits(rng.randrange(1, 4)), f"v{digits(1)}", digits(rng.randrange(4, 7))])
    date = lambda by: by.join((f"20{digits(2)}", f"{rng.randrange(1, 13):02d}", f"{rng.randrange(1, 29):02d}"))
    clock = lambda by: by.join(f"{rng.randrange(60):02d}" for _ in range(3))
    kind = rng.randrange(12)
    if kind == 0:
        return rng.choice(["/", ""]) + "/".join(w + number() for w in pick(rng.randrange(3, 8)))
    if kind == 1:
        return f"{rng.choice(['http', 'https'])}//www/{pick(1)[0]}/com/" + "/".join(pick(2)) + rng.choice(["", f"/{date('/')}/"]) + "-".join(pick(3))
    if kind in (2, 3):
        by = "_-"[kind - 2]
        return by.join(w for w in (x for y in pick(rng.randrange(3, 7)) for x in (y, number())) if w)
    if kind == 4:
        return "_".join(pick(rng.randrange(3, 6))).upper() + rng.choice(["", f"_{digits(rng.randrange(1, 5))}"])
    if kind in (5, 6, 7):
        out = "".join(w.capitalize() + rng.choice(["", "", "", digits(1), "V" + digits(1)]) for w in pick(rng.randrange(3, 7)))
        return out if kind < 7 else out[0].lower() + out[1:]
    if kind == 8:
        return "-".join(hexes(n) for n in (8, 4, 4, 4, 12))
    if kind == 9:
        return f"{pick(1)[0]}{rng.choice('-_')}{date(rng.choice(['-', '', '_']))}{rng.choice('T-_')}{clock(rng.choice(['-', '']))}{rng.choice(['', 'Z', '-' + pick(1)[0]])}"
    if kind == 10:
        return f"{rng.choice(pick(1)[0:1]).upper()[: rng.randrange(2, 9)]}-{digits(rng.randrange(6, 13))}-{date('-')}"
    return "".join(pick(rng.randrange(3, 6)))


def samples(rng: random.Random, label: int, n: int, words: list[str] = WORDS) -> list[str]:
    """n long tokens of a label: 1 random strings over usual alphabets, 0 ordinary ones."""
    out: list[str] = []
    while len(out) < n:
        x = "".join(rng.choices(rng.choice(ALPHABETS), k=rng.randrange(LEAST["markov"], 65))) if label else ordinary(rng, words)
        if len(x) >= LEAST["markov"]:
            out.append(x)
    return out


def _bytes(tokens: list[str]) -> np.ndarray:
    return np.frombuffer(("\n".join(tokens) + "\n").encode(), np.uint8)


class Model(NamedTuple):
    """ratio: of each transition; margins: mean nats above which a token of a length is random."""

    ratio: np.ndarray
    margins: np.ndarray

    def means(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        score = np.concatenate([[0.0], np.cumsum(self.ratio[steps(data)], dtype=np.float64)])
        return (score[e] - score[s]) / np.maximum(e - s, 1)

    def random(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return self.means(data, s, e) > self.margins[np.searchsorted(LENGTHS, e - s, "right") - 1]


def taught() -> list[tuple[int, int, int]]:
    """(label, transition, count) of labelled samples, the same ones always."""
    out = []
    for label in (0, 1):
        data = _bytes(samples(random.Random(label), label, TAUGHT, [w for w in WORDS if w not in HELD]))
        n = np.bincount(steps(data)[CODE[data] != START], minlength=N**3)
        out += [(label, int(c), int(n[c])) for c in np.flatnonzero(n)]
    return out


def calibrated(ratio: np.ndarray) -> Model:
    """Margins that let through LET of ordinary samples, of words which the model was not taught."""
    data = _bytes(samples(random.Random(2), 0, TRIED, HELD))
    s, e = tokens(data)
    means, size = Model(ratio, np.zeros(0)).means(data, s, e), np.searchsorted(LENGTHS, e - s, "right") - 1
    return Model(ratio, np.array([max(LEAST_MARGIN, float(np.quantile(means[size == k], 1 - LET))) for k in range(len(LENGTHS))]))


def train(docs: DataFrame) -> Model:
    """Counts over whole documents, as labelled by the fixed patterns, and over labelled samples
    of what documents may hold too little of. What reaches the driver is a table of at most
    2 * 68 ** 3 cells, whatever the corpus."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts()
        for batch in batches:
            data, offsets = buffer(batch.column(0))
            for i, j in slices(offsets):
                counts.add(parted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0])
        label, cell = np.nonzero(counts.n)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(cell), pa.array(counts.n[label, cell])], ["label", "cell", "n"])

    cells = docs.select("text").transform(in_arrow, work, "label int, cell long, n long").groupBy("label", "cell").agg(F.sum("n").alias("n"))
    return calibrated(ratios([*(tuple(r) for r in cells.collect()), *taught()]))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """Returns a row per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_markov.

    A token of 20 or more characters outside the base spans is a secret if its transitions
    favour the random model by more than its length's margin of nats each on average. Spans count code points and are
    kind:start:end by start, then kind. Null and empty texts have no spans; extra columns are
    ignored; repeated rows each give a row; no match crosses a row's end.
    """
    ids = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def found(data: np.ndarray) -> list[tuple[int, int, int]]:
        base = base_spans(data)
        taken = np.zeros(len(data) + 1, np.int32)
        for spans in base.values():
            for s, e in spans:
                taken[s] += 1
                taken[e] -= 1
        taken = np.cumsum(taken)[:-1] > 0
        s, e = tokens(data)
        long = e - s >= LEAST["markov"]
        s, e = s[long], e[long]
        if len(s):
            free = np.add.reduceat(np.append(taken, False), np.stack([s, e], 1).ravel())[::2] == 0
            free &= shared.value.random(data, s, e)
            s, e = s[free], e[free]
        base["markov"] = list(zip(s.tolist(), e.tolist(), strict=True))
        return sorted((a, k, b) for k, kind in enumerate(KINDS) for a, b in base[kind])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffer(batch.column(1))
            rows: list[tuple] = []
            for i, j in slices(offsets):
                part, at = parted(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                spans = found(part)
                points = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
                of = np.searchsorted(at, [s for s, _, _ in spans], "right") - 1
                own: list[list[tuple[int, int, int]]] = [[] for _ in range(j - i)]
                for r, (s, k, e) in zip(of.tolist(), spans, strict=True):
                    first = points[at[r]]
                    own[r].append((int(points[s] - first), k, int(points[e] - first)))
                for x in own:
                    say = [f"{KINDS[k]}:{s}:{e}" for s, k, e in x]
                    base = ",".join(t for t, (_, k, _) in zip(say, x, strict=True) if k < 3)
                    rows.append((*(sum(k == n for _, k, _ in x) for n in range(4)), hashlib.sha256(base.encode()).hexdigest(), ",".join(say)))
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            a, b, c, m, digest, say = (pa.array(list(x), kind) for x, kind in zip(cols, kinds, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(0), a, b, c, digest, say, m], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov"])

    return docs.select("doc_id", "text").transform(in_arrow, work, f"doc_id {ids}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long")


def secrets(docs: DataFrame) -> DataFrame:
    """train() and scan() over the same documents: a row per row, as scan() says. An empty table
    gives no rows; null and empty texts teach nothing; repeated rows count each."""
    return scan(docs, train(docs))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
