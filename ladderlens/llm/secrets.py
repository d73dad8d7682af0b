"""Secret scans: fixed patterns, and automata inferred from labelled credentials.

Labelled credentials (strings with their format) go into one prefix tree for
each format.  Where a node has few different next characters, as in the literal
start of a format, the tree keeps the characters themselves; elsewhere it reads
classes of characters, of which each node takes the smallest that covers its own.  States whose outgoing frequencies
differ by no more than chance (Hoeffding bound, down the whole subtree) merge,
red-blue order, which leaves a deterministic probabilistic automaton.

Every part of a run of credential characters is a candidate: it starts anywhere
in the run that an automaton can start at, and ends at the run's end or before
a separator.  Its score is the mean, over its characters, of log likelihood
under the format against a plain model of text, trained on ordinary sentences.
From each start, the longest part above ``threshold`` is a ``format`` span; the
next one starts after it.

Defined results: a null text counts as empty and has no span.  Spans are in
code points, end exclusive, by start and then kind as in KINDS.  Texts of any
length are scanned whole.  An empty table gives no rows.  Repeated rows each
get their own row; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from ladderlens.llm.common import beside, each, named
from ladderlens.llm.licenses import OTHER, PLAIN, TEMPLATES

KINDS = ("assign", "access", "hex", "format")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so this equals [0-9a-f]+ of 16 and more
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SEPARATORS = frozenset("+/_.=-")
SHORTEST = 16
#: Least mean log-likelihood ratio of a credential.
THRESHOLD = 0.5
#: Text that repeats itself: places between repeats at most, and characters in a row that show it.
PERIODS, PERIODIC = 8, 3

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ALNUM, HEXES = UPPER + LOWER + DIGITS, "0123456789abcdef"
#: Classes of characters, small ones first.
CLASSES = {"0": DIGITS, "h": HEXES, "b": LOWER + DIGITS, "B": UPPER + DIGITS, "l": UPPER + LOWER, "w": ALNUM, "*": ALNUM + "+/_.=-"}
#: Public credential formats, as parts: literal texts of which one is taken, or an alphabet with the lengths it is used at.
FORMATS: dict[str, list[tuple]] = {
    "access_id": [("AKIA", "ASIA"), (UPPER + "234567", (16,))],
    "personal_token": [("ghp_", "gho_", "ghs_"), (ALNUM, (36,))],
    "fine_token": [("github_pat_",), (ALNUM, (22,)), ("_",), (ALNUM, (59,))],
    "payment_key": [("sk_live_", "rk_live_"), (ALNUM, tuple(range(24, 41)))],
    "map_key": [("AIza",), (ALNUM + "-_", (35,))],
    "chat_token": [("xoxb-", "xoxp-"), (DIGITS, (10, 11, 12)), ("-",), (DIGITS, (10, 11, 12)), ("-",), (ALNUM, (24,))],
    "group_token": [("glpat-",), (ALNUM + "-_", (20,))],
    "package_token": [("npm_",), (ALNUM, (36,))],
    "model_token": [("hf_",), (UPPER + LOWER, (34,))],
    "mail_key": [("SG.",), (ALNUM + "-_", (22,)), (".",), (ALNUM + "-_", (43,))],
    "web_token": [("eyJ",), (ALNUM, (17, 33)), (".eyJ",), (ALNUM, tuple(range(30, 80, 2))), (".",), (ALNUM + "-_", (43,))],
    "hex_token": [(HEXES, (32, 40, 64))],
}


def drawn(r: random.Random, parts: list[tuple]) -> str:
    """A credential of a format."""
    return "".join("".join(r.choice(p[0]) for _ in range(r.choice(p[1]))) if isinstance(p[-1], tuple) else r.choice(p) for p in parts)


def labelled(per_format: int = 300, seed: int = 11) -> dict[str, list[str]]:
    """Examples of each format, drawn with a fixed seed."""
    r = random.Random(seed)
    return {name: [drawn(r, parts) for _ in range(per_format)] for name, parts in FORMATS.items()}


class Automaton:
    """Probabilistic automaton: for each state, symbol to (next state, probability) and the probability to stop.

    A symbol is ``=`` and a character, or a class.  Where a character has
    several symbols, the likeliest counts.
    """

    def __init__(self, moves: list[dict[str, tuple[int, float]]], stop: list[float]) -> None:
        self.moves, self.stop = moves, stop
        self.table: list[dict[str, tuple[int, float]]] = [{} for _ in moves]
        for own, table in zip(moves, self.table, strict=True):
            for x, (to, p) in own.items():
                chars = x[1] if x[0] == "=" else CLASSES[x]
                for ch in chars:
                    if p / len(chars) > math.exp(table.get(ch, (0, -math.inf))[1]):
                        table[ch] = (to, math.log(p / len(chars)))
        self.openings = tuple(sorted(self._literals(0, "")))

    def _literals(self, state: int, before: str) -> Iterator[str]:
        literal = [x for x in self.moves[state] if x[0] == "="]
        if len(before) == 4 or len(literal) < len(self.moves[state]) or self.stop[state] or not literal:
            yield before
        else:
            for x in literal:
                yield from self._literals(self.moves[state][x][0], before + x[1])

    def starts(self, run: str) -> list[int]:
        """Where a credential may start in a run: at a literal opening, or where characters that it starts with begin."""
        if self.openings == ("",):
            own = [ch in self.table[0] for ch in run]
            return [i for i, x in enumerate(own) if x and not (i and own[i - 1])]
        out = set()
        for x in self.openings:
            i = run.find(x)
            while i >= 0:
                out.add(i)
                i = run.find(x, i + 1)
        return sorted(out)

    def log_likelihood(self, text: str) -> float:
        """Log-likelihood of text; -inf if it leaves the automaton."""
        state, total = 0, 0.0
        for ch in text:
            step = self.table[state].get(ch)
            if step is None:
                return -math.inf
            state, total = step[0], total + step[1]
        return total + (math.log(self.stop[state]) if self.stop[state] > 0 else -math.inf)


#: A node of at least so many examples, with at most so many next characters, keeps those.
SURE, FEW = 20, 4


def symbols(examples: list[str]) -> list[list[str]]:
    """The symbols of each example: characters at nodes that have few, else the smallest class that covers a node's.

    A node of few examples tells little, so it takes the class of the node before, if that will do.
    """
    out: list[list[str]] = [[] for _ in examples]
    nodes = {0: list(range(len(examples)))}
    for depth in range(max(map(len, examples))):
        below: dict[int, list[int]] = {}
        for path, own in nodes.items():
            own = [k for k in own if len(examples[k]) > depth]
            chars = {examples[k][depth] for k in own}
            exact = len(own) >= SURE and len(chars) <= FEW
            old = [out[k][-1] for k in own[:1] if depth and out[k][-1][0] != "="] if len(own) < SURE else []
            kind = next(c for c in [*old, *CLASSES] if chars <= set(CLASSES[c]))
            for k in own:
                out[k].append(f"={examples[k][depth]}" if exact else kind)
                below.setdefault(hash((path, out[k][-1])), []).append(k)
        nodes = below
    return out


def infer(examples: list[str], alpha: float = 0.05) -> Automaton:
    """Merge compatible states of the examples' prefix tree (red-blue order)."""
    child: list[dict[str, int]] = [{}]
    count: list[dict[str, int]] = [{}]
    ends, arrive = [0], [0]
    for x in symbols(examples):
        s = 0
        arrive[0] += 1
        for ch in x:
            if ch not in child[s]:
                child[s][ch] = len(child)
                for table in (child, count):
                    table.append({})
                ends.append(0)
                arrive.append(0)
            count[s][ch] = count[s].get(ch, 0) + 1
            s = child[s][ch]
            arrive[s] += 1
        ends[s] += 1

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (n1**-0.5 + n2**-0.5)

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if differ(ends[a], arrive[a], ends[b], arrive[b]):
                return False
            for ch in child[a].keys() | child[b].keys():
                if differ(count[a].get(ch, 0), arrive[a], count[b].get(ch, 0), arrive[b]):
                    return False
                if ch in child[a] and ch in child[b]:
                    todo.append((child[a][ch], child[b][ch]))
        return True

    def fold(a: int, b: int) -> None:
        """Add the subtree of b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            ends[a] += ends[b]
            arrive[a] += arrive[b]
            for ch, nxt in child[b].items():
                count[a][ch] = count[a].get(ch, 0) + count[b][ch]
                if ch in child[a]:
                    todo.append((child[a][ch], nxt))
                else:
                    child[a][ch] = nxt

    red, known = [0], {0}
    while True:
        blue = next(((p, ch) for p in red for ch in sorted(child[p]) if child[p][ch] not in known), None)
        if blue is None:
            break
        b = child[blue[0]][blue[1]]
        into = next((r for r in red if compatible(r, b)), None)
        if into is None:
            red.append(b)
            known.add(b)
        else:
            child[blue[0]][blue[1]] = into
            fold(into, b)
    at = {s: i for i, s in enumerate(red)}
    moves = [{ch: (at[child[s][ch]], count[s][ch] / arrive[s]) for ch in child[s]} for s in red]
    return Automaton(moves, [ends[s] / arrive[s] for s in red])


@lru_cache(maxsize=1)
def letter_pairs() -> dict[tuple[str, str], float]:
    """Log-probability of a letter after another within words, from ordinary sentences."""
    text = " ".join([*PLAIN, *OTHER, *(t for ts in TEMPLATES.values() for t in ts)]).lower()
    pairs = Counter(zip(text, text[1:]))  # noqa: B905
    after = {a: sum(pairs[a, b] for b in LOWER) for a in LOWER}
    return {(a, b): math.log((pairs[a, b] + 0.5) / (after[a] + 13)) for a in LOWER for b in LOWER}


def plain_steps(text: str) -> Iterator[float]:
    """What each character adds to the log-probability of plain_model.

    Once PERIODIC characters in a row are those some places before, with PERIODS
    places at most, the next one is likely to go on so.
    """
    pairs, before, old, repeats = letter_pairs(), "", "", [0] * (PERIODS + 1)
    for i, ch in enumerate(text):
        again, period = max((n, -p) for p, n in enumerate(repeats) if p)
        for p in range(1, PERIODS + 1):
            repeats[p] = repeats[p] + 1 if i >= p and text[i - p] == ch else 0
        now = "l" if ch.islower() else "A" if ch.isupper() else "0" if ch.isdigit() else ch
        same = now == before or (before == "A" and now == "l")
        if same and now in "lA" and (pair := (old.lower(), ch.lower())) in pairs:
            step = math.log(0.9) + pairs[pair]
        else:
            step = math.log((0.9 if same else 0.04) / {"l": 26, "A": 26, "0": 10}.get(now, 1))
        if again >= PERIODIC:
            step = math.log(0.1 * math.exp(step) + (0.9 if text[i + period] == ch else 0.0))
        yield step
        before, old = now, ch


def plain_model(text: str) -> float:
    """Log-probability of a run of text under a plain model: words, whose letters follow each other as in sentences, and what repeats itself."""
    return sum(plain_steps(text))


def format_score(automata: Sequence[Automaton], run: str) -> float:
    """The best format's log-likelihood ratio for each character of the run."""
    best = max(a.log_likelihood(run) for a in automata)
    return -math.inf if best == -math.inf else (best - plain_model(run)) / len(run)


class Walks:
    """Walks of an automaton along a run, from several starts.

    A walk that reaches a state at a place where an earlier one was in it too
    goes on with that one's steps, so all walks together take few.
    """

    def __init__(self, automaton: Automaton, run: str, plain: list[float], threshold: float) -> None:
        self.automaton, self.run, self.plain, self.threshold = automaton, run, plain, threshold
        self.seen: dict[tuple[int, int], tuple[int, float]] = {}  # (place, state): walk, its log-likelihood there
        self.walks: list[tuple[list[int], list[float], tuple[int, int, float] | None]] = []

    def longest(self, at: int, need: float) -> int:
        """Where the longest part from ``at`` ends whose log-likelihood, less those of the plain model and the threshold, is ``need`` or more; 0 if none."""
        a, run, own = self.automaton, self.run, []
        i, state, total, into = at, 0, 0.0, None
        while True:
            if (i, state) in self.seen:
                k, there = self.seen[i, state]
                into = (k, i, total - there)
                break
            self.seen[i, state] = (len(self.walks), total)
            if a.stop[state] > 0 and (i == len(run) or run[i] in SEPARATORS):
                own.append((i, total + math.log(a.stop[state]) - self.plain[i] - self.threshold * i))
            step = a.table[state].get(run[i]) if i < len(run) else None
            if step is None:
                break
            state, i, total = step[0], i + 1, total + step[1]
        ends, scores = [], []  # later ends first; an earlier one only with a higher score
        for end, score in reversed(own):
            if not scores or score > scores[-1]:
                ends.append(end)
                scores.append(score)
        self.walks.append((ends, scores, into))
        tail, k, least = [], len(self.walks) - 1, at
        while True:
            tail.append((k, least, need))
            if self.walks[k][2] is None:
                break
            k, least, more = self.walks[k][2]
            need -= more
        for k, least, need in reversed(tail):
            ends, scores, _ = self.walks[k]
            x = bisect_left(scores, need)
            if x < len(ends) and ends[x] >= least:
                return ends[x]
        return 0


def format_parts(automata: Sequence[Automaton], run: str, threshold: float) -> Iterator[tuple[int, int]]:
    """(start, end) of the credentials in a run."""
    able: dict[int, list[int]] = {}
    for k, a in enumerate(automata):
        for at in a.starts(run):
            able.setdefault(at, []).append(k)
    if not able:
        return
    plain = list(accumulate(plain_steps(run), initial=0.0))
    walks, done = [Walks(a, run, plain, threshold) for a in automata], 0
    for at in sorted(able):
        if at < done or len(run) - at < SHORTEST:
            continue
        first = plain[at + 1] - plain[at] - plain_model(run[at])  # the first character has none before it
        end = max(walks[k].longest(at, -plain[at] - first - threshold * at - 1e-9) for k in able[at])
        if end - at >= SHORTEST:
            done = end
            yield at, end


def spans(text: str, automata: Sequence[Automaton], threshold: float) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans of a text."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        found += [(m.start() + a, m.start() + b, "format") for a, b in format_parts(automata, m[0], threshold)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


@lru_cache(maxsize=4)
def trained(alpha: float = 0.05) -> tuple[Automaton, ...]:
    """An automaton for each format of the labelled credentials."""
    return tuple(infer(examples, alpha) for examples in labelled().values())


def scan(docs: DataFrame, keep: list[str], threshold: float = THRESHOLD, automata: Sequence[Automaton] | None = None, text: str = "text") -> DataFrame:
    """The columns in keep, and ``spans``: an array of (start, end, kind)."""
    automata = automata or trained()

    def derive(columns: list[pa.Array]):
        return {"spans": [[{"start": a, "end": b, "kind": k} for a, b, k in spans(t, automata, threshold)] if t else [] for t in each(columns[0])]}, None

    return beside(docs, keep, [text], "spans array<struct<start: int, end: int, kind: string>>", lambda: derive)


def redacted(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    """text with each span, or run of spans that touch or overlap, replaced by mark."""
    out, end = [], 0
    for a, b, _ in found:
        if a > end or not out:
            out += [text[end:a], mark]
        end = max(end, b)
    return "".join([*out, text[end:]])


def redact(docs: DataFrame, mark: str = "[SECRET]", threshold: float = THRESHOLD, automata: Sequence[Automaton] | None = None, text: str = "text") -> DataFrame:
    """All rows of docs; every secret in the text is replaced by mark."""
    automata = automata or trained()

    def derive(columns: list[pa.Array]):
        return {text: [redacted(t, spans(t, automata, threshold), mark) if t else t for t in each(columns[0])]}, None

    rest = [c for c in docs.columns if c != text]
    return beside(docs, rest, [text], StructType([StructField(text, StringType())]), lambda: derive).select(*map(named, docs.columns))
