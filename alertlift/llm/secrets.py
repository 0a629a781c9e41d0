"""Secret scan with base patterns and inferred credential grammars (operator 8).

Base patterns mark credentials of three kinds.  The credentials they mark are the labelled strings of grammar
inference: per kind a prefix tree with counts is built over character classes, and states of one depth are merged when
the frequencies of every class and of the end agree at all later places within a Hoeffding bound.  So lengths, fixed
prefixes and the order of classes survive.  Ordinary long tokens give a background automaton in the same way.  Every
candidate (a token, or what base matches leave of one) is then scored as a whole by the likelihood of its format: it is
marked when some kind explains it as well as its own labelled strings (neither worse nor better, as a plain number
would be under a hexadecimal format), and better than the background by a margin.  Where a candidate does not pass, its parts
between separators are scored, and windows of each kind's commonest length in it and in its parts, one every
``STEP`` characters and the last.

Automata of credentials are fitted on about ``STRINGS`` strings of each kind out of all base matches of the corpus, the
background on as many tokens of about ``SAMPLE_DOCS`` documents.  Scanning reads all texts whole.

Defined results: a null text counts as empty and has no spans; repeated rows get equal spans; with fewer than
``FEWEST`` labelled strings of a kind there is no grammar for it, and without any only base spans are found; an empty
table gives no rows.  Spans count code points, ends exclusive; spans of one start come in the order of ``KINDS``.
Only doc_id and text are read, so extra columns cannot clash.
"""

from __future__ import annotations

import hashlib
import math
import pickle
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from alertlift.llm import textarrays as ta
from alertlift.llm.shipping import ship

KINDS = ("assign", "access", "hex", "format")
SAMPLE_DOCS, STRINGS, FEWEST = 20_000, 800, 20
#: Shortest candidate, levels of an automaton before its last state repeats, and certainty of the merge test.
CANDIDATE, SEEN, ALPHA = 16, 64, 0.05
#: Strings below which a state is not tested but joins the nearest one, and weight of the classes of all places in each state.
FEW, SMOOTH = 20, 1.0
#: Characters between the starts of the windows of a candidate.
STEP = 16
#: Share of the labelled strings left out at either end of the range of likelihoods, and nats a character over the background.
QUANTILE, MARGIN = 0.02, 0.35
#: Least share of a class, whatever the labelled strings hold.
UNSEEN = 1e-4

#: The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{CANDIDATE},}}")
#: Parts of a token between separators.
_PART = re.compile(rf"[A-Za-z0-9]{{{CANDIDATE},}}")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

_LONG = np.zeros(256, dtype=bool)
_LONG[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True


def _character_class(c: str) -> str:
    if c.isdigit():
        return "d"
    if c.isalpha():
        return ("h" if c in "abcdef" else "l") if c.islower() else ("H" if c in "ABCDEF" else "U")
    return c


_NUMBER: dict[str, int] = {}
_CLASS = {c: _NUMBER.setdefault(_character_class(c), len(_NUMBER)) for c in map(chr, np.flatnonzero(_LONG))}
CLASSES = len(_NUMBER)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns: leftmost non-overlapping matches of each kind, failing ones dropped."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    # Runs of at least 24 are the runs of any length, which never touch, that are long enough.
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def credentials(text: str, others: bool = True) -> list[tuple[str, str]]:
    """Labelled strings of a text: (kind, credential), and ("other", token) for long tokens outside of base spans."""
    out = [("assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", m[0]) for m in HEX.finditer(text)]
    if not others:
        return out
    return out + [("other", text[a:b]) for a, b in candidates(text, base_spans(text), shortest=8)]


def candidates(text: str, base: list[tuple[int, int, int]], shortest: int = CANDIDATE) -> list[tuple[int, int]]:
    """Tokens, and the parts of tokens that base spans leave, of ``shortest`` characters or more."""
    tokens = _TOKEN if shortest == CANDIDATE else re.compile(rf"[A-Za-z0-9+/_.=-]{{{shortest},}}")
    out, first = [], 0
    for m in tokens.finditer(text):
        at, end = m.span()
        # Base spans are sorted by start; those that end before this token do not matter to later ones either.
        while first < len(base) and base[first][2] <= at:
            first += 1
        for a, _, b in base[first:]:
            if a >= end:
                break
            if a - at >= shortest:
                out.append((at, a))
            at = max(at, b)
        if end - at >= shortest:
            out.append((at, end))
    return out


class Automaton:
    """An acyclic probabilistic automaton: compatible prefix-tree states of one depth are merged, level by level.

    A state's profile is how often each class, or the end, comes at every later place of its strings; two states merge
    where no entry differs by more than a Hoeffding bound.  States of fewer than ``FEW`` strings join the nearest
    state of their level.  Levels keep fixed prefixes and lengths apart; from place ``SEEN`` on one state repeats.
    ``tails`` are the counts of classes beyond that place, given where ``strings`` hold the first places only (None: shorter).
    """

    def __init__(self, strings: list[str], tails: list[np.ndarray | None] | None = None):
        tails = [tail_counts(s) for s in strings] if tails is None else tails
        codes = np.full((len(strings), SEEN), -1, dtype=np.int8)
        for row, string in zip(codes, strings, strict=True):
            own = [_CLASS[c] for c in string[:SEEN]]
            row[: len(own)] = own
            if len(own) < SEEN:
                row[len(own)] = CLASSES
        lengths = np.array([len(s[:SEEN]) + (0 if t is None else int(t.sum())) for s, t in zip(strings, tails, strict=True)])
        #: The commonest length, the least of equally common ones.
        self.length = int(np.bincount(lengths).argmax())
        beyond = np.zeros(CLASSES + 1)
        for tail in tails:
            if tail is not None:
                beyond += np.append(tail, 1)
        total = np.bincount(codes[codes >= 0], minlength=CLASSES + 1) + beyond
        prior = np.maximum(total / total.sum(), UNSEEN)
        self.least = self.most = 0.0
        self._build(codes, beyond, prior / prior.sum())

    def _build(self, codes: np.ndarray, beyond: np.ndarray, prior: np.ndarray) -> None:
        counts: list[np.ndarray] = []
        steps: list[dict[int, int]] = []
        levels: list[list[int]] = []
        groups = [np.arange(len(codes))]
        for depth in range(SEEN):
            levels.append(list(range(len(counts), len(counts) + len(groups))))
            children = []
            for state, own in zip(levels[-1], groups, strict=True):
                at = codes[own, depth]
                counts.append(np.bincount(at[at >= 0], minlength=CLASSES + 1).astype(float))
                steps.append({})
                children += [(state, c, own[at == c]) for c in range(CLASSES) if counts[state][c]]
            groups, joined = _merged(codes, depth + 1, [own for _, _, own in children])
            for (state, c, _), k in zip(children, joined, strict=True):
                steps[state][c] = len(counts) + k
            if not groups:
                break
        # All paths of SEEN characters end in one state that repeats; unknown paths in a state that knows the classes only.
        last, anywhere = len(counts), len(counts) + 1
        counts += [beyond, np.zeros(CLASSES + 1)]
        self.log = np.log((np.array(counts) + SMOOTH * prior) / (np.array(counts).sum(axis=1) + SMOOTH)[:, None])
        self.next = np.full((len(counts), CLASSES), anywhere)
        for depth, level in enumerate(levels):
            largest = last if depth + 1 == SEEN else levels[depth + 1][0] if depth + 1 < len(levels) else anywhere
            self.next[level] = largest
            if depth + 1 < SEEN:
                for state in level:
                    for c, k in steps[state].items():
                        self.next[state, c] = k
        self.next[last] = last
        #: States that learned something, for reports.
        self.states = [i for i, own in enumerate(counts) if own.sum()]

    def per_character(self, string: str) -> float:
        """Log-likelihood of the string's format with its end, divided by its characters."""
        total, at = 0.0, 0
        for c in string[:SEEN]:
            c = _CLASS[c]
            total += self.log[at, c]
            at = self.next[at, c]
        tail = tail_counts(string)
        if tail is not None:
            total += float(self.log[at, :CLASSES] @ tail)
        return float(total + self.log[at, CLASSES]) / max(len(string), 1)

    def explains(self, string: str, own: float) -> bool:
        """The likelihood lies where those of the automaton's labelled strings do."""
        return self.least <= own <= self.most


def tail_counts(string: str) -> np.ndarray | None:
    """How often each class comes behind the first SEEN characters; None where the string ends before."""
    if len(string) < SEEN:
        return None
    return np.bincount([_CLASS[c] for c in string[SEEN:]], minlength=CLASSES)


def _profile(codes: np.ndarray, depth: int, own: np.ndarray) -> np.ndarray:
    """Share of the strings with each class, or the end, at every place from ``depth`` on."""
    ahead = codes[own, depth:].astype(np.int64) + 1
    places = ahead.shape[1]
    flat = ahead + np.arange(places) * (CLASSES + 2)
    return np.bincount(flat.ravel(), minlength=places * (CLASSES + 2)) / len(own)


def _merged(codes: np.ndarray, depth: int, children: list[np.ndarray]) -> tuple[list[np.ndarray], list[int]]:
    """Groups of a level, largest child first, and the group of each child."""
    groups: list[np.ndarray] = []
    profiles: list[np.ndarray] = []
    joined = [0] * len(children)
    for i in sorted(range(len(children)), key=lambda i: (-len(children[i]), i)):
        own = children[i]
        profile = _profile(codes, depth, own)
        apart = [float(np.abs(profile - other).max(initial=0.0)) for other in profiles]
        into = None
        if len(own) < FEW and groups:
            into = int(np.argmin(apart))
        else:
            certain = math.sqrt(0.5 * math.log(2 * max(profile.size, 1) / ALPHA))
            into = next((k for k, far in enumerate(apart) if far <= certain * (len(own) ** -0.5 + len(groups[k]) ** -0.5)), None)
        if into is None:
            into = len(groups)
            groups.append(own)
            profiles.append(profile)
        else:
            groups[into] = np.concatenate([groups[into], own])
            profiles[into] = _profile(codes, depth, groups[into])
        joined[i] = into
    return groups, joined


@dataclass
class Grammars:
    """Automata by kind, with the range of their own strings' likelihoods, and the background's automaton."""

    kinds: dict[str, Automaton]
    background: Automaton | None

    def is_credential(self, token: str) -> bool:
        ordinary = self.background.per_character(token) if self.background else -math.log(CLASSES)
        for automaton in self.kinds.values():
            own = automaton.per_character(token)
            if automaton.explains(token, own) and own - ordinary >= MARGIN:
                return True
        return False

    def found(self, token: str) -> list[tuple[int, int]]:
        """Stretches of a candidate that are credentials: the whole, or else its parts, and windows of the kinds' lengths."""
        if self.is_credential(token):
            return [(0, len(token))]
        parts = {m.span() for m in _PART.finditer(token) if m.end() - m.start() < len(token)}
        windows: set[tuple[int, int]] = set()
        for size in {max(CANDIDATE, automaton.length) for automaton in self.kinds.values()}:
            for a, b in [(0, len(token)), *parts]:
                if size < b - a:
                    windows |= {(at, at + size) for at in (*range(a, b - size, STEP), b - size)}
        marked: list[tuple[int, int]] = []
        for a, b in sorted(p for p in parts | windows if self.is_credential(token[p[0] : p[1]])):
            if marked and a <= marked[-1][1]:
                marked[-1] = (marked[-1][0], max(b, marked[-1][1]))
            else:
                marked.append((a, b))
        return marked

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        base = base_spans(text)
        return sorted(base + [(a + x, 3, a + y) for a, b in candidates(text, base) for x, y in self.found(text[a:b])])


def _suspects(texts: ta.Texts) -> np.ndarray:
    """Texts that hold a keyword or a long run of token characters; no other can have a span."""
    out = np.zeros(texts.n, dtype=bool)
    lowered = texts.lowered().data.tobytes()
    for word in _KEYWORDS:
        at = lowered.find(word)
        while at >= 0:
            row = int(np.searchsorted(texts.offsets, at, side="right")) - 1
            out[row] = True
            at = lowered.find(word, max(int(texts.offsets[row + 1]) - len(word) + 1, at + 1))
    long = ta.runs(_LONG[texts.data], texts.offsets)
    out[long.row[long.end - long.start >= CANDIDATE]] = True
    return out


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled strings: their first SEEN characters, and the counts of classes behind those."""
    for batch in batches:
        kinds, strings, tails = [], [], []
        for texts in ta.slices(batch.column(0)):
            sampled = batch.column(1).slice(texts.first, texts.n).to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(sampled | _suspects(texts)):
                for kind, string in credentials(texts.text(i), sampled[i]):
                    tail = tail_counts(string)
                    kinds.append(kind)
                    strings.append(string[:SEEN])
                    tails.append(None if tail is None else tail.tolist())
        yield pa.RecordBatch.from_arrays(
            [pa.array(kinds, pa.string()), pa.array(strings, pa.string()), pa.array(tails, pa.list_(pa.int64()))], ["kind", "string", "tail"]
        )


def _infer(members: pd.DataFrame) -> pd.DataFrame:
    kind, n = members["kind"].iloc[0], len(members)
    if n < FEWEST:
        return pd.DataFrame({"kind": [kind], "automaton": [b""]})
    tails = [None if t is None else np.asarray(t) for t in members["tail"]]
    order = sorted(range(n), key=lambda i: (members["string"].iloc[i], () if tails[i] is None else tuple(tails[i])))
    strings, tails = [members["string"].iloc[i] for i in order], [tails[i] for i in order]
    automaton = Automaton(strings, tails)
    # Strings of over SEEN characters are judged by the order of their first places and the counts of the rest.
    scores = [automaton.per_character(s + _spelled(t)) for s, t in zip(strings, tails, strict=True)]
    automaton.least, automaton.most = (float(x) for x in np.quantile(scores, (QUANTILE, 1 - QUANTILE)))
    return pd.DataFrame({"kind": [kind], "automaton": [pickle.dumps(automaton)]})


def _spelled(tail: np.ndarray | None) -> str:
    """Some string with these counts of classes."""
    some = {k: c for c, k in _CLASS.items()}
    return "" if tail is None else "".join(some[k] * int(n) for k, n in enumerate(tail))


def infer(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, strings: int = STRINGS) -> Grammars:
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    n = rows.select("doc_id").count()
    unit = F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 30)) / float(1 << 30)
    sampled = F.coalesce(unit < sample_docs / max(n, 1), F.lit(False)).alias("sampled")
    found = rows.select("text", sampled).mapInArrow(_labelled, "kind string, string string, tail array<long>").distinct()
    # The strings with the smallest hashes of each kind; a hash below the limit of its kind's expected number.
    counted = found.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    drawn = F.pmod(F.xxhash64("string", "tail"), F.lit(1 << 30)) / float(1 << 30)
    chosen = found.join(counted, "kind").filter(drawn < strings / F.col("n")).select("kind", "string", "tail")
    learned = chosen.groupBy("kind").applyInPandas(_infer, "kind string, automaton binary").collect()
    automata = {r["kind"]: pickle.loads(bytes(r["automaton"])) for r in learned if r["automaton"]}
    background = automata.pop("other", None)
    return Grammars(dict(sorted(automata.items())), background)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "<secret>") -> str:
    """The text with every maximal stretch covered by spans replaced."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a >= end:
            if end >= 0:
                at = end
            out += [text[at:a], mark]
            end = b
        end = max(end, b)
    return "".join(out) + text[max(end, 0) :] if spans else text


def _scan(grammars, carried: list[str]) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = grammars.value
        for batch in batches:
            for texts in ta.slices(batch.column(0)):
                found = [[]] * texts.n
                for i in np.flatnonzero(_suspects(texts)):
                    found[i] = model.spans(texts.text(i))
                base = [[s for s in spans if s[1] < 3] for spans in found]
                counts = [pa.array([sum(s[1] == k for s in spans) for spans in base], pa.int64()) for k in range(3)]
                digest = [hashlib.sha256(written(spans).encode()).hexdigest() for spans in base]
                own = [c.slice(texts.first, texts.n) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays(
                    [*own, *counts, pa.array(digest), pa.array([written(s) for s in found], pa.string())],
                    [*carried, "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
                )

    return run


def scan(docs: DataFrame, grammars: Grammars, *carried: str) -> DataFrame:
    """The carried columns, counts of base spans, their digest, and all spans of the whole text."""
    spark = ship(docs.sparkSession)
    rows = docs.select(F.col("text").cast("string"), *carried)
    schema = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in carried)
    return rows.mapInArrow(
        _scan(spark.sparkContext.broadcast(grammars), list(carried)),
        f"{schema}n_assign long, n_access long, n_hex long, base_sha256 string, spans string",
    )


def _redact(grammars, names: list[str]) -> Callable:  # noqa: ANN001  a broadcast
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in ta.slices(batch.column(0)):
                suspect = _suspects(texts)
                column = batch.column(0).slice(texts.first, texts.n)
                if suspect.any():
                    values = column.to_pylist()
                    for i in np.flatnonzero(suspect):
                        values[i] = redact(values[i], grammars.value.spans(values[i]))
                    column = pa.array(values, pa.string())
                yield pa.RecordBatch.from_arrays([column, *(c.slice(texts.first, texts.n) for c in batch.columns[1:])], names)

    return run


def quoted(name: str) -> str:
    """A column's name for use in a path, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def redacted(docs: DataFrame, grammars: Grammars) -> DataFrame:
    """All rows and columns, with the spans in ``text`` replaced by a mark."""
    spark = ship(docs.sparkSession)
    # Names are free to hold dots or backticks: columns go by number.
    place = {c: f"c{i}" for i, c in enumerate(docs.columns) if c != "text"}
    rows = docs.select(F.col("text").cast("string").alias("text"), *[F.col(quoted(c)).alias(n) for c, n in place.items()])
    found = rows.mapInArrow(_redact(spark.sparkContext.broadcast(grammars), ["text", *place.values()]), rows.schema)
    return found.select(*[F.col(place.get(c, "text")).alias(c) for c in docs.columns])


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, infer(docs), "doc_id")
