"""Secret scans: fixed patterns, and credential formats learnt by grammar inference.

Three patterns (``assign``, ``access``, ``hex``) give the base spans. On top of them, probabilistic automata learnt from
labelled credentials score every other candidate, a run of credential characters. For each format a prefix tree of its
examples is folded by state merging: two states are merged when the relative frequencies of their ends and of each next
character differ by no more than a Hoeffding bound, and so do those of all states below them (red-blue order, as in ALERGIA).
The automaton of everyday tokens is learnt alike from kinds of characters (small and capital letters, digits, and each
separator), letters and digits of a kind being alike likely. A candidate's score is its best format's log2 likelihood over
that of the everyday automaton, a character, or a ``WEIGHED``-th of it for runs of fewer characters, so that a short run needs
as much evidence as one of that length. At ``THRESHOLD`` and above the run is a ``grammar`` span, unless a base span covers it.

Every run is scored whole, all runs of a batch at once by tables of the automata. In a run of ``WEIGHED`` characters or more
with separators (``+ / _ . = -``) the parts from one to another are scored alike, the whole among them, as a credential may
stand in an assignment, a URL or a path. The parts that lie apart and have the most bits over the threshold together are the
spans, each widened to what a format accepts as a whole; a part after the first costs ``SPLIT`` bits. They are found in one walk along the run: open parts that have brought a format and the
everyday automaton to the same states have the same future, so only the best of them goes on.

The examples are labelled by construction: a seeded generator writes them from the publicly documented formats, so no
real credential is kept here. ``learn`` takes any other labelled strings.

Texts are scanned as UTF-8 bytes, whole; the patterns are ASCII, and spans are reported in code points.

Cases: a null or empty text has no spans; a null id is kept; repeated rows give repeated results; an empty table gives an
empty result; a very long text or run takes time in proportion; only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import bisect
import math
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import arrow_map, flat, runs, table

KINDS = ("assign", "access", "hex", "grammar")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
MIN_SECRET, MIN_ACCESS, MIN_HEX = 6, 20, 24
#: Bits a character by which a format must beat everyday tokens, and the characters that a shorter run counts as, those of the shortest format.
THRESHOLD, WEIGHED = 0.8, 20
#: Bits by which two parts of a run must beat one, as credentials hold separators themselves.
SPLIT = 32.0
#: Confidence of the tests by which states are kept apart: of formats, and of the everyday automaton.
ALPHA, EVERYDAY_ALPHA = 0.05, 0.3
#: Longer runs are scored one at a time.
LONG_RUN = 256

HEX_CLASS = np.zeros(256, bool)
HEX_CLASS[list(b"0123456789abcdef")] = True
RUN_CLASS = np.zeros(256, bool)
RUN_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")] = True
SEPARATORS = "+-./=_"
SEPARATOR_CLASS = np.zeros(256, bool)
SEPARATOR_CLASS[list(SEPARATORS.encode())] = True

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALPHABET = UPPER + LOWER + DIGITS + SEPARATORS
#: The kind of a character, and the bits that tell it from others of its kind.
KIND_OF = {c: kind[0] if len(kind) > 1 else kind for kind in (UPPER, LOWER, DIGITS, *SEPARATORS) for c in kind}
KIND_BITS = {c: math.log2(len(kind)) for kind in (UPPER, LOWER, DIGITS, *SEPARATORS) for c in kind}
#: Place of a byte in the alphabet.
PLACE = np.zeros(256, np.int64)
PLACE[list(ALPHABET.encode())] = np.arange(len(ALPHABET))


def labelled_credentials(n: int = 160, seed: int = 7) -> dict[str, list[str]]:
    """``n`` examples of each format, by format; ``everyday`` holds the tokens that are no credentials."""
    rng = random.Random(seed)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    formats = {
        "access_key": lambda: "AKIA" + some(UPPER + "234567", 16),
        "forge_token": lambda: rng.choice(("ghp_", "gho_", "ghs_")) + some(UPPER + LOWER + DIGITS, 36),
        "chat_token": lambda: "xoxb-" + some(DIGITS, 12) + "-" + some(DIGITS, 12) + "-" + some(UPPER + LOWER + DIGITS, 24),
        "payment_key": lambda: rng.choice(("sk_live_", "rk_live_")) + some(UPPER + LOWER + DIGITS, 24),
        "maps_key": lambda: "AIza" + some(UPPER + LOWER + DIGITS + "_-", 35),
        "web_token": lambda: "eyJ" + some(UPPER + LOWER + DIGITS, rng.randint(17, 40)) + ".eyJ" + some(UPPER + LOWER + DIGITS, rng.randint(20, 60)) + "." + some(UPPER + LOWER + DIGITS + "_-", 43),
        "hex_key": lambda: some(DIGITS + "abcdef", rng.choice((32, 40, 64))),
        "base64_key": lambda: some(UPPER + LOWER + DIGITS + "+/", 43) + "=",
    }
    found = {name: [make() for _ in range(n)] for name, make in formats.items()}
    return found | {"everyday": everyday_tokens(5 * n // 2, seed)}


def everyday_tokens(n: int, seed: int = 7) -> list[str]:
    """``n`` tokens of each form that running text, code and paths have."""
    rng = random.Random(seed)
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    number = lambda most: some(DIGITS, rng.randint(1, most))
    part = lambda: some(LOWER, min(rng.randint(2, 9), rng.randint(2, 40)))
    word = lambda: some(LOWER, rng.randint(1, 12) if rng.random() < 0.8 else rng.randint(12, 40))
    joined = lambda sep, make, most: sep.join(make() for _ in range(rng.randint(2, most)))
    end = lambda: rng.choice(("", "", "", ".", "=", "-"))
    tail = lambda: rng.choice(("", "", rng.choice("-_/.=") + number(6), number(4)))
    forms = (
        lambda: word() + end(),
        lambda: word().upper() + end(),
        lambda: word().capitalize() + end(),
        lambda: some(UPPER, rng.randint(2, 4)) + word() + end(),
        lambda: joined("", lambda: part().capitalize(), 5) + rng.choice(("", number(4))),
        lambda: number(30) if rng.random() < 0.5 else joined(rng.choice(".-/"), lambda: number(4), 5),
        lambda: rng.choice(("", "+", "-", "=")) + number(4) + rng.choice(("", part(), part().upper())),
        lambda: f"{rng.randint(1990, 2040)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}T{rng.randint(0, 23):02d}.{rng.randint(0, 59):02d}.{rng.randint(0, 59):02d}",
        lambda: joined(rng.choice("-_/.="), part, 6) + tail(),
        lambda: (joined(rng.choice("-_/.="), part, 6) + tail()).upper(),
        lambda: joined(rng.choice("-_/."), lambda: part().capitalize(), 6) + end(),
        lambda: "v" + ".".join(number(3) for _ in range(3)) + "-" + part() + "." + number(2),
        lambda: "/" + "/".join(part() for _ in range(rng.randint(1, 5))) + rng.choice(("", "/", "." + some(LOWER, 3), "/" + number(6))),
        lambda: rng.choice("-=_./+") * rng.randint(1, 40) + rng.choice(("", part() + number(2) + "-" * rng.randint(2, 20))),
    )
    return [make() for make in forms for _ in range(n)]


class Automaton:
    """A probabilistic deterministic automaton: per state its passes, ends and, by character, next state and count."""

    def __init__(self, examples: Iterable[str], alpha: float = ALPHA, kinds: bool = False):
        """kinds: learn from the kinds of characters."""
        self.kinds = kinds
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        self.ends = [0]
        self.passes = [0]
        for text in examples:
            self._insert("".join(map(KIND_OF.__getitem__, text)) if kinds else text)
        self._reduce(math.sqrt(0.5 * math.log(2 / alpha)))
        self._score()

    def _insert(self, text: str) -> None:
        at = 0
        for c in text:
            self.passes[at] += 1
            self.count[at][c] = self.count[at].get(c, 0) + 1
            if c not in self.next[at]:
                self.next[at][c] = len(self.next)
                self.next.append({})
                self.count.append({})
                self.ends.append(0)
                self.passes.append(0)
            at = self.next[at][c]
        self.passes[at] += 1
        self.ends[at] += 1

    def _compatible(self, red: int, blue: int, bound: float) -> bool:
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            n, m = self.passes[a], self.passes[b]
            if not n or not m:
                continue
            gap = bound * (n**-0.5 + m**-0.5)
            if abs(self.ends[a] / n - self.ends[b] / m) > gap:
                return False
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / n - self.count[b].get(c, 0) / m) > gap:
                    return False
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, red: int, blue: int) -> None:
        """Add the tree below ``blue`` to ``red``; the tree's states are not used again."""
        todo = [(red, blue)]
        while todo:
            a, b = todo.pop()
            self.passes[a] += self.passes[b]
            self.ends[a] += self.ends[b]
            for c, k in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + k
                if c in self.next[a]:
                    todo.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _reduce(self, bound: float) -> None:
        red, seen = [0], {0}
        while True:
            blue = next(((a, c, b) for a in red for c, b in sorted(self.next[a].items()) if b not in seen), None)
            if blue is None:
                break
            parent, c, state = blue
            for other in red:
                if self._compatible(other, state, bound):
                    self.next[parent][c] = other
                    self._fold(other, state)
                    break
            else:
                red.append(state)
                seen.add(state)
        self.states = len(red)
        self._keep(red)

    def _keep(self, states: list[int]) -> None:
        """Only the states that are left, numbered in their order; the first stays the first."""
        number = {state: i for i, state in enumerate(states)}
        self.next = [{c: number[b] for c, b in self.next[a].items()} for a in states]
        self.count, self.ends, self.passes = ([own[a] for a in states] for own in (self.count, self.ends, self.passes))

    def _score(self) -> None:
        """Log2 probabilities, with a little mass kept for characters and ends not seen."""
        self.step: list[dict[str, tuple[float, int]]] = []
        self.other: list[float] = []
        self.stop: list[float] = []
        for at in range(len(self.next)):
            whole = self.passes[at] + 1.0
            counts, after = self.count[at], self.next[at]
            if self.kinds:
                self.step.append({c: (math.log2((counts.get(kind, 0) + 1 / 128) / whole) - KIND_BITS[c], after.get(kind, 0)) for c, kind in KIND_OF.items()})
            else:
                self.step.append({c: (math.log2((k + 1 / 128) / whole), after[c]) for c, k in counts.items()})
            self.other.append(math.log2(1 / 128 / whole))
            self.stop.append(math.log2((self.ends[at] + 1 / 128) / whole))

    def likelihood(self, text: str) -> float:
        """Log2 probability of ``text``; an unseen character leads back to the start."""
        at, total = 0, 0.0
        for c in text:
            p, at_next = self.step[at].get(c, (self.other[at], 0))
            total += p
            at = at_next
        return total + self.stop[at]


class Tables:
    """An automaton's reachable states as arrays: log2 probability and next state by state and character, and of ending."""

    def __init__(self, automaton: Automaton):
        order, number = [0], {0: 0}
        for at in order:
            for _, there in automaton.step[at].values():
                if there not in number:
                    number[there] = len(order)
                    order.append(there)
        self.bits = np.array([[automaton.step[at].get(c, (automaton.other[at], 0))[0] for c in ALPHABET] for at in order]).ravel()
        self.after = np.array([[number[automaton.step[at].get(c, (0, 0))[1]] for c in ALPHABET] for at in order]).ravel() * len(ALPHABET)
        self.stop = np.array([automaton.stop[at] for at in order])

    def likelihoods(self, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log2 probability of each run of ``codes``; sizes fall."""
        at, total = np.zeros(len(starts), np.int64), np.zeros(len(starts))
        live = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), "left")
        for k, n in enumerate(live.tolist()):
            place = at[:n] + codes[starts[:n] + k]
            total[:n] += self.bits[place]
            at[:n] = self.after[place]
        return total + self.stop[at // len(ALPHABET)]


def learn(examples: dict[str, list[str]]) -> dict[str, Automaton]:
    """An automaton for each label; ``everyday`` is the one that formats have to beat."""
    return {name: Automaton(found, EVERYDAY_ALPHA, True) if name == "everyday" else Automaton(found) for name, found in examples.items()}


def format_score(automata: dict[str, Automaton], text: str) -> float:
    """Bits a character by which the likeliest format beats everyday tokens."""
    best = max(a.likelihood(text) for name, a in automata.items() if name != "everyday")
    return (best - automata["everyday"].likelihood(text)) / max(WEIGHED, len(text))


def best_parts(automata: dict[str, Automaton], text: str) -> tuple[float, list[tuple[int, int]]]:
    """The parts of ``text`` between separators that reach the threshold, lie apart and have the most bits over it together.

    Each part after the first costs ``SPLIT``. A part's bits are those over everyday tokens less ``THRESHOLD`` a character. Open parts are kept by format, by the states
    of both automata and by their length up to ``WEIGHED``: of those with all that in common, the one that is best with what
    lies before it.
    """
    forms, everyday = [a for name, a in automata.items() if name != "everyday"], automata["everyday"]
    best, came, part = [0.0], [0], [False]
    parts: dict[tuple, tuple[float, int]] = {}
    size = len(text)
    for at, c in enumerate(text):
        if at == 0 or text[at - 1] in SEPARATORS:
            for k in range(len(forms)):
                parts[k, 0, 0, 0] = (max(0.0, best[at] - SPLIT), at)
        moved: dict[tuple, tuple[float, int]] = {}
        for (k, f, e, length), (total, start) in parts.items():
            gain, f = forms[k].step[f].get(c) or (forms[k].other[f], 0)
            cost, e = everyday.step[e].get(c) or (everyday.other[e], 0)
            key = (k, f, e, min(length + 1, WEIGHED))
            total += gain - cost - THRESHOLD
            held = moved.get(key)
            if held is None or held[0] < total:
                moved[key] = (total, start)
        parts = moved
        best.append(best[at])
        came.append(at)
        part.append(False)
        if c in SEPARATORS or at + 1 == size or text[at + 1] in SEPARATORS:
            for (k, f, e, length), (total, start) in parts.items():
                total += forms[k].stop[f] - everyday.stop[e] - THRESHOLD * (WEIGHED - length)
                if total > best[-1] and total >= best[start] - SPLIT:
                    best[-1], came[-1], part[-1] = total, start, True
    found, at = [], size
    while at and best[at] > 0:
        if part[at]:
            found.append((came[at], at))
            if best[came[at]] <= SPLIT:  # what lies before is not worth it
                break
        at = came[at]
    return best[-1], found[::-1]


def widened(automata: dict[str, Automaton], text: str, span: tuple[int, int], low: int, high: int) -> tuple[int, int]:
    """``span`` with the widest part from ``low`` to ``high`` that holds its start and half of it, that a format accepts, and that
    reaches the threshold."""
    least = (span[0] + span[1] + 1) // 2
    for start in [i for i in range(low, span[0] + 1) if i == 0 or text[i - 1] in SEPARATORS]:
        stop = 0
        for name, form in automata.items():
            at = 0
            for i in range(start, high if name != "everyday" else start):
                if (seen := form.step[at].get(text[i])) is None:
                    break
                at = seen[1]
                if i + 1 >= max(least, stop) and form.ends[at] and (i + 1 == len(text) or text[i] in SEPARATORS or text[i + 1] in SEPARATORS):
                    stop = i + 1
        if stop and format_score(automata, text[start:stop]) >= THRESHOLD:
            return start, max(stop, span[1])
    return span


def credential_parts(automata: dict[str, Automaton], text: str) -> list[tuple[int, int]]:
    """The best parts as ``start, stop``, widened to what a format accepts as a whole; those side by side are one."""
    joined: list[tuple[int, int]] = []
    parts = best_parts(automata, text)[1]
    for span, (high, _) in zip(parts, [*parts[1:], (len(text), 0)], strict=False):
        a, b = widened(automata, text, span, joined[-1][1] if joined else 0, high)
        if joined and joined[-1][1] == a:
            joined[-1] = (joined[-1][0], b)
        else:
            joined.append((a, b))
    return joined


class Covered:
    """Tells whether an interval lies in one of some spans."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.starts, self.ends = [], []
        for start, _, stop in sorted(spans):
            self.starts.append(start)
            self.ends.append(max(stop, self.ends[-1]) if self.ends else stop)

    def holds(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.starts, a)
        return i > 0 and self.ends[i - 1] >= b


class Scanner:
    """Finds the spans of a batch of texts."""

    def __init__(self, automata: dict[str, Automaton]):
        self.automata = automata
        self.tables = {name: Tables(a) for name, a in automata.items()}

    def scan(self, raw: np.ndarray, at: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its spans ``start, kind, end`` in bytes of the text, sorted; kinds by place in ``KINDS``."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(at) - 1)]
        data = raw.tobytes()

        def place(start: int) -> int:
            return int(np.searchsorted(at, start, "right")) - 1

        for k, (low, high) in enumerate(zip(*runs(HEX_CLASS[raw], at, MIN_HEX), strict=True)):
            i = place(low)
            found[i].append((int(low - at[i]), 2, int(high - at[i])))
        for i in self._holding(data, at, (b"AKIA",)):
            for m in ACCESS.finditer(data, at[i], at[i + 1]):
                if m.end() - m.start() >= MIN_ACCESS:
                    found[i].append((int(m.start() - at[i]), 1, int(m.end() - at[i])))
        for i in self._holding(data.lower(), at, KEYWORDS):
            for m in ASSIGN.finditer(data, at[i], at[i + 1]):
                if m.end(2) - m.start(2) >= MIN_SECRET:
                    found[i].append((int(m.start() - at[i]), 0, int(m.end() - at[i])))
        self._candidates(raw, at, data, found)
        for spans in found:
            spans.sort()
        return found

    @staticmethod
    def _holding(data: bytes, at: np.ndarray, needles: tuple[bytes, ...]) -> list[int]:
        """The texts that hold one of the needles."""
        hit = set()
        for needle in needles:
            p = data.find(needle)
            while p >= 0:
                i = int(np.searchsorted(at, p, "right")) - 1
                hit.add(i)
                p = data.find(needle, max(p + 1, int(at[i + 1]) - len(needle) + 1))
        return sorted(hit)

    def scores(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """``format_score`` of each run."""
        sizes, codes = stops - starts, PLACE[raw]
        found = np.zeros(len(starts))
        order = np.argsort(-sizes, kind="stable")
        order = order[sizes[order] <= LONG_RUN]
        # runs of up to eight bytes are scored once each
        short = order[sizes[order] <= 8]
        room = np.concatenate((raw, np.zeros(8, np.uint8)))
        packed = room[starts[short][:, None] + np.arange(8)]
        packed[np.arange(8) >= sizes[short][:, None]] = 0
        _, first, back = np.unique(packed.view(np.uint64).ravel(), return_index=True, return_inverse=True)
        once = np.sort(first)
        rows = np.concatenate((order[: len(order) - len(short)], short[once]))
        own_starts, own_sizes = starts[rows], sizes[rows]
        best = np.full(len(rows), -np.inf)
        for name, table in self.tables.items():
            if name != "everyday":
                np.maximum(best, table.likelihoods(codes, own_starts, own_sizes), out=best)
        best -= self.tables["everyday"].likelihoods(codes, own_starts, own_sizes)
        found[rows] = best / np.maximum(WEIGHED, own_sizes)
        found[short] = found[short[first]][back]
        for i in np.flatnonzero(sizes > LONG_RUN).tolist():
            found[i] = format_score(self.automata, raw[starts[i] : stops[i]].tobytes().decode("ascii"))
        return found

    def _candidates(self, raw: np.ndarray, at: np.ndarray, data: bytes, found: list) -> None:
        starts, stops = runs(RUN_CLASS[raw], at, 1)
        if not len(starts):
            return
        whole = self.scores(raw, starts, stops) >= THRESHOLD
        parted = np.concatenate(([0], np.cumsum(SEPARATOR_CLASS[raw])))
        several = (stops - starts >= WEIGHED) & (parted[stops] > parted[starts])
        told = np.flatnonzero(whole | several)
        covered: dict[int, Covered] = {}
        for k in told.tolist():
            low, high = int(starts[k]), int(stops[k])
            i = int(np.searchsorted(at, low, "right")) - 1
            base = covered.get(i) or covered.setdefault(i, Covered(found[i]))
            a, b = low - int(at[i]), high - int(at[i])
            if base.holds(a, b):
                continue
            if not several[k]:
                found[i].append((a, 3, b))
            else:
                for s, e in credential_parts(self.automata, data[low:high].decode("ascii")):
                    if not base.holds(a + s, a + e):
                        found[i].append((a + s, 3, a + e))


SCHEMA = "n_assign long, n_access long, n_hex long, n_grammar long, base string, spans string"


def scan(docs: DataFrame, automata: dict[str, Automaton] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row its counts by kind, and its base and all spans as ``kind:start:end`` joined by commas."""
    learnt = automata or learn(labelled_credentials())

    def make():
        scanner = Scanner(learnt)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, at = flat(batch.column("text"))
            rows: list[tuple] = []
            for i, spans in enumerate(scanner.scan(raw, at)):
                if spans:
                    own = raw[at[i] : at[i + 1]]
                    points = np.concatenate(([0], np.cumsum((own & 0xC0) != 0x80)))
                    said = [(k, f"{KINDS[k]}:{points[s]}:{points[e]}") for s, k, e in spans]
                    n = [sum(k == kind for k, _ in said) for kind in range(4)]
                    rows.append((*n, ",".join(x for k, x in said if k < 3), ",".join(x for _, x in said)))
                else:
                    rows.append((0, 0, 0, 0, "", ""))
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["key", "n_assign", "n_access", "n_hex", "n_grammar", "base", "spans"])

        return step

    return arrow_map(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), make, f"key {dict(docs.dtypes)[key]}, {SCHEMA}").withColumnRenamed("key", key)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("base"), 256).alias("base_sha256"), "spans", "n_grammar")


def redact(docs: DataFrame, text: str = "text", mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every span of every kind replaced by ``mark``; the other columns as they are."""
    learnt = learn(labelled_credentials())
    # the text goes first, as it decides how batches are cut; the order is put back after
    first = docs.select(text, *(c for c in docs.columns if c != text))

    def make():
        scanner = Scanner(learnt)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            column = batch.column(0)
            raw, at = flat(column)
            texts = None
            for i, spans in enumerate(scanner.scan(raw, at)):
                if not spans:
                    continue
                texts = column.to_pylist() if texts is None else texts
                own, parts, done = raw[at[i] : at[i + 1]].tobytes(), [], 0
                for s, _, e in spans:
                    if s >= done:
                        parts += [own[done:s], mark.encode()]
                    done = max(done, e)
                texts[i] = b"".join([*parts, own[done:]]).decode()
            if texts is None:
                return batch
            return pa.RecordBatch.from_arrays([pa.array(texts, column.type), *batch.columns[1:]], schema=batch.schema)

        return step

    return arrow_map(first, make, first.schema).select(*docs.columns)
