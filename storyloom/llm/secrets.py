"""Secret scans: fixed patterns, and a linear-chain conditional random field over all tokens of a text, decoded by Viterbi."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from storyloom.llm.common import map_batches

KINDS = ["assign", "access", "hex", "crf"]
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
_FOREIGN = re.compile(r"[^\x00-\x7f]")
_LEAD, _TAIL = re.compile(r"""[^\s"'=:(\[{<>]*["'=:(\[{<>]+(?=[^"'=:(\[{<>])"""), re.compile(r"""["'.,;:!?)\]}>]+\Z""")
_ALIKE = {ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"} | {ord(c): "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
_PLACE = re.compile(r"://|@[A-Za-z0-9-]+\.[A-Za-z]|\Awww\.|\A[~.]?/[a-z]|\.(?:com|org|net|html?|py|txt|pdf|jpg)\b")
_USERINFO = re.compile(r"://[^\s/:@]*:([^\s/@]+)@")
_KEY_WORDS = frozenset("password passwd pwd passphrase secret token apikey key auth authorization bearer credential credentials login access private api client".split())
_CLASSES = {"start": 0, "word": 1, "key": 2, "assign": 3, "quote": 4, "sign": 5, "number": 6, "mixed": 7}
_GROUPS = ["word", "long", "longest", "short_mixed", "mixed", "long_mixed", "digits", "signed", "signed_mixed", "capitals", "place", "signs"]
_DISTANCES = np.array([0, 1, 2, 3, 4, 5, 5, 6, 6, 6, 7])  # of the last key word, in tokens; further off: the last

OUTSIDE, BEGIN, INSIDE = range(3)
_TAGS = 3
_NEVER = -1e4
TRAINING_LINES, STEPS, RATE, SHRINK = 3000, 100, 0.2, 2e-4
CHARACTERS_AT_ONCE, VOCABULARY = 2_000_000, 200_000

Span = tuple[int, int, int]  # start, kind, end


def base_spans(text: str) -> list[Span]:
    """Spans of the three fixed patterns, leftmost and non-overlapping per kind; matches that are too short are dropped."""
    lower = text.lower()
    found: list[Span] = []
    if "passw" in lower or "secret" in lower or "token" in lower or "api" in lower:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def shape(token: str) -> str:
    """Runs of lower case, capitals and digits as a, A and 0, the sign of a sign; cut after eight."""
    return re.sub(r"[0-9]+", "0", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", token)))[:8]


def _turns(t: str) -> int:
    """Changes between lower case, capitals, digits and signs; a capital at the start of a word is none."""
    kinds = ["d" if c.isdigit() else "a" if c.islower() else "A" if c.isupper() else "s" for c in t]
    return sum(a != b and not (a == "A" and b == "a") for a, b in zip(kinds, kinds[1:], strict=False))


def group(core: str) -> int:
    """What kind of string this is, as a place in ``_GROUPS``."""
    n, digits, letters = len(core), sum(c.isdigit() for c in core), sum(c.isalpha() for c in core)
    if not digits and not letters:
        name = "signs"
    elif _PLACE.search(core):
        name = "place"
    elif not letters:
        name = "digits"
    elif digits + letters < n:
        name = "signed_mixed" if digits else "signed"
    elif digits:
        name = "short_mixed" if n < 6 else "mixed" if n < 16 else "long_mixed"
    elif n >= 16 and core.isupper():
        name = "capitals"
    else:
        name = "word" if n < 12 else "long" if n < 18 else "longest"
    return _GROUPS.index(name)


def token_class(token: str) -> int:
    if token.lower() in _KEY_WORDS:
        return _CLASSES["key"]
    if not token.isalnum():
        return _CLASSES["assign" if token in "=:" else "quote" if token in "\"'`" else "sign"]
    digits = sum(map(str.isdigit, token))
    return _CLASSES["word" if not digits else "number" if digits == len(token) else "mixed"]


def chunk_features(chunk: str) -> list[tuple[list[str], int, int, int]]:
    """For each token of a run without white space: what can be told from the run alone, the token's class, the kind of the run's core, and whether
    the token stands before, in or after the core. The core is what follows a leading name and sign of assignment, without closing punctuation; of a link with a password, the password."""
    lead = _LEAD.match(chunk)
    lo = lead.end() if lead and not _PLACE.search(chunk) else 0
    tail = _TAIL.search(chunk, lo)
    hi = tail.start() if tail and tail.start() > lo else len(chunk)
    inside = _USERINFO.search(chunk) if "://" in chunk else None
    if inside:  # the password in a link is a core of its own
        lo, hi = inside.span(1)
    core = chunk[lo:hi]
    kind, n = group(core), len(core)
    turns, digits = _turns(core), sum(c.isdigit() for c in core)
    hexed = n >= 8 and all(c in "0123456789abcdef" for c in core) and 0 < digits < n
    vowels = sum(c in "aeiouAEIOU" for c in core) / n if n >= 16 else 0
    of_core = [f"kind={kind}", f"kind={kind},length={min(n // 4, 10)}", f"turns={min(turns, 12)}", f"turns/length={5 * turns // max(1, n)}", f"hex={hexed},{min(n // 8, 4)}", f"digits={4 * digits // max(1, n)}", f"vowels={int(8 * vowels) if n >= 16 else '-'}", f"mixed={turns >= 6 and n >= 20 and kind in (5, 8)}", f"head={shape(core)[:4]}", f"lead={lo > 0}", f"userinfo={inside is not None}"]
    out = []
    seen = False
    for m in _TOKEN.finditer(chunk):
        where = 0 if m.start() < lo else 1 if m.start() < hi else 2
        first = where == 1 and not seen
        seen |= where == 1
        t = m[0]
        own = ["bias", f"where={where},first={first}", f"shape={shape(t)}", f"size={min(len(t) // 4, 8)}", f"class={token_class(t)},first={first}"]
        out.append((own + [f"{x},{where},{first}" for x in of_core], token_class(t), kind, where))
    return out


def file_code(text: str, base: list[Span]) -> int:
    """Features of the file, as one number: has it sure secrets, mail addresses, lines."""
    return bool(base) * 6 + ("@" in text) * 3 + min(2, text.count("\n"))


_N_CLASS, _N_GROUP, _N_NEAR, _N_FILE = len(_CLASSES), len(_GROUPS), int(_DISTANCES.max()) + 1, 12


class Chain:
    """A linear-chain CRF with three tags: weights of named features of a token in its run, of its surroundings by number, and of pairs of tags."""

    def __init__(self) -> None:
        self.names: dict[str, int] = {}
        self.named = np.zeros((0, _TAGS))
        self.near = np.zeros((_N_NEAR * _N_GROUP * 3, _TAGS))  # distance of the last key word, kind of the core, place in the run
        self.before = np.zeros((_N_CLASS * 2 * 3, _TAGS))  # class of the token before, glued to it, place in the run
        self.after = np.zeros((_N_CLASS * 3, _TAGS))
        self.file = np.zeros((_N_FILE * _N_GROUP, _TAGS))
        self.moves = np.zeros((_TAGS, _TAGS))
        self.moves[OUTSIDE, INSIDE] = _NEVER  # a secret begins before it goes on

    def parts(self) -> list[np.ndarray]:
        return [self.named, self.near, self.before, self.after, self.file, self.moves]


class Tokens:
    """The tokens of some texts in arrays, in order; runs that come again are looked up."""

    def __init__(self, names: dict[str, int], learning: bool = False) -> None:
        self.names, self.learning = names, learning
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.patterns: dict[str, int] = {}
        self.first, self.count = [], []
        self.features: list[list[int]] = []
        self.class_, self.kind, self.where, self.glued = [], [], [], []
        self.arrays: tuple | None = None

    def run_number(self, chunk: str) -> int:
        """The number of a new run. Plain words that look alike (same length, capitals and closing signs) have the same features, so they share a number."""
        core = chunk.rstrip(string.punctuation)
        alike = None
        if len(core) < 16 and core.isalpha() and core.lower() not in _KEY_WORDS:
            alike = (chunk if chunk.isascii() else _FOREIGN.sub(lambda m: "é" if m[0].islower() else "É" if m[0].isupper() else "中", chunk)).translate(_ALIKE)
        if alike in self.patterns:
            self.known[chunk] = self.patterns[alike]
            return self.patterns[alike]
        self.arrays = None
        self.known[chunk] = number = len(self.first)
        if alike is not None:
            self.patterns[alike] = number
        self.first.append(len(self.features))
        for i, (names, class_, kind, where) in enumerate(chunk_features(chunk)):
            if self.learning:
                for x in names:
                    self.names.setdefault(x, len(self.names))
            self.features.append([self.names[x] for x in names if x in self.names])
            self.class_.append(class_)
            self.kind.append(kind)
            self.where.append(where)
            self.glued.append(i > 0)
        self.count.append(len(self.features) - self.first[-1])
        return number

    def laid(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the known tokens in all texts, the number of tokens of each text, and the number of runs of each text."""
        if len(self.known) > VOCABULARY:
            self.clear()
        known, new = self.known, self.run_number
        runs, sizes = [], []
        for text in texts:
            chunks = text.split()
            sizes.append(len(chunks))
            runs += [known[c] if c in known else new(c) for c in chunks]
        if self.arrays is None:
            self.arrays = tuple(np.array(x, np.int64) for x in (self.first, self.count, self.class_, self.kind, self.where, self.glued))
        first, count = self.arrays[:2]
        at = np.array(runs, np.int64)
        n = count[at]
        ends = np.cumsum(n)
        tokens = np.repeat(first[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
        run_ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        token_ends = np.concatenate(([0], ends))[run_ends]
        return tokens, np.diff(token_ends), np.array(sizes)


def surroundings(tokens: Tokens, at: np.ndarray, sizes: np.ndarray, files: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each token the rows of the chain's tables ``near``, ``before``, ``after`` and ``file``, and whether it is glued to the token before."""
    class_, kind, where, glued = (x[at] for x in tokens.arrays[2:])
    n = len(at)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    begin = np.repeat(starts, sizes)
    place = np.arange(n)
    before = np.where(place > begin, np.roll(class_, 1), _CLASSES["start"])
    after = np.where(place < begin + np.repeat(sizes, sizes) - 1, np.roll(class_, -1), _CLASSES["start"])
    key = np.maximum.accumulate(np.where(class_ == _CLASSES["key"], place, -1))  # this token or one before
    last = np.concatenate(([-1], key[:-1])) if n else key
    gap = np.where((last >= begin) & (last >= 0), np.minimum(place - last, len(_DISTANCES) - 1), len(_DISTANCES) - 1)
    return (_DISTANCES[gap] * _N_GROUP + kind) * 3 + where, (before * 2 + glued) * 3 + where, after * 3 + where, np.repeat(files, sizes) * _N_GROUP + kind, glued


def emissions(chain: Chain, own: np.ndarray, around: tuple[np.ndarray, ...]) -> np.ndarray:
    near, before, after, file, glued = around
    out = own + chain.near[near] + chain.before[before] + chain.after[after] + chain.file[file]
    out[:, INSIDE] += np.where(glued == 1, 0.0, _NEVER)  # no secret goes over white space
    return out


def time_major(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places that put the tokens of all sequences side by side: (place of each token, offset of each step, sequences still open at each step)."""
    order = np.argsort(-sizes, kind="stable")
    rank = np.empty(len(sizes), np.int64)
    rank[order] = np.arange(len(sizes))
    steps = int(sizes.max()) if len(sizes) else 0
    open_ = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), side="right")
    offset = np.concatenate(([0], np.cumsum(open_))).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum())) - np.repeat(starts, sizes)
    return offset[step] + np.repeat(rank, sizes), offset, open_


def viterbi(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The best tag of each token, for sequences of ``sizes`` one after the other in ``scores``; all sequences go forward together."""
    if not len(scores):
        return np.empty(0, np.int8)
    place, offset, open_ = time_major(sizes)
    wide = np.empty_like(scores)
    wide[place] = scores
    back, tags = np.zeros((len(scores), _TAGS), np.int8), np.empty(len(scores), np.int8)
    final = np.empty((int(open_[0]), _TAGS))
    best = wide[: open_[0]].copy()
    best[:, INSIDE] += _NEVER
    for t in range(1, len(open_)):
        if open_[t] < len(best):
            final[open_[t] : len(best)] = best[open_[t] :]
        ways = best[: open_[t], :, None] + moves
        at = slice(offset[t], offset[t + 1])
        back[at] = ways.argmax(axis=1)
        best = ways.max(axis=1) + wide[at]
    final[: len(best)] = best
    now = final.argmax(axis=1).astype(np.int8)
    for t in range(len(open_) - 1, -1, -1):
        k = open_[t]
        if t + 1 < len(open_):
            j = open_[t + 1]
            now[:j] = back[offset[t + 1] + np.arange(j), now[:j]]
        tags[offset[t] : offset[t] + k] = now[:k]
    return tags[place]


def beliefs(scores: np.ndarray, moves: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance of each tag at each token, and the expected number of each pair of tags, by the forward-backward sums."""
    place, offset, open_ = time_major(sizes)
    wide = np.empty_like(scores)
    wide[place] = scores
    wide[: open_[0], INSIDE] += _NEVER
    forward, backward = wide.copy(), np.zeros_like(wide)
    for t in range(1, len(open_)):
        before = forward[offset[t - 1] : offset[t - 1] + open_[t]]
        forward[offset[t] : offset[t + 1]] += np.logaddexp.reduce(before[:, :, None] + moves, axis=1)
    pairs = np.zeros((_TAGS, _TAGS))
    for t in range(len(open_) - 1, 0, -1):
        ahead = wide[offset[t] : offset[t + 1]] + backward[offset[t] : offset[t + 1]]
        backward[offset[t - 1] : offset[t - 1] + open_[t]] = np.logaddexp.reduce(moves + ahead[:, None, :], axis=2)
    for t in range(1, len(open_)):
        before = forward[offset[t - 1] : offset[t - 1] + open_[t]]
        ahead = wide[offset[t] : offset[t + 1]] + backward[offset[t] : offset[t + 1]]
        both = before[:, :, None] + moves + ahead[:, None, :]
        pairs += np.exp(both - np.logaddexp.reduce(both.reshape(len(both), -1), axis=1)[:, None, None]).sum(axis=0)
    total = forward + backward
    return np.exp(total - np.logaddexp.reduce(total, axis=1)[:, None])[place], pairs


def training_lines(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int]]]]:
    """Made-up lines with the places of their secrets. Some secrets are split by signs, some have no digit, some are short; the other lines hold
    look-alikes (cards, phones, mail, links, versions, long words) and key words in plain sentences."""
    r = random.Random(seed)
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    caps, mixed = low.upper(), low + low.upper() + digits
    common = "the of and to a in is was for on that with as it my our their new old first lost found over under garden door house letter weapon meaning idea note point life value required wrong reset changed forgotten expired policy manager holder ring number list".split()

    def run(of: str, lo: int, hi: int) -> str:
        return "".join(r.choice(of) for _ in range(r.randint(lo, hi)))

    def spoken(parts: int) -> str:
        return "".join(r.choice(["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "st", "t", "tr", "v", "w"]) + r.choice(["a", "e", "i", "o", "u", "ie", "ou"]) + r.choice(["", "", "n", "r", "s"]) for _ in range(parts))

    def word() -> str:
        w = r.choice([lambda: r.choice(common), lambda: spoken(r.randint(1, 4)), lambda: spoken(r.randint(1, 3)).capitalize(), lambda: spoken(r.randint(5, 8)) if r.random() < 0.2 else r.choice(common)])()
        return w + r.choice(["", "", "", "", ",", ".", "!", ";", "?", "-" + spoken(1)])

    def words(lo: int, hi: int) -> str:
        return " ".join(word() for _ in range(r.randint(lo, hi)))

    def strong() -> str:
        """Recognizable without a name before it."""
        return r.choice([lambda: "gh" + r.choice("pos") + "_" + run(mixed, 36, 36), lambda: "sk-" + run(mixed, 24, 48), lambda: "xox" + r.choice("bp") + "-" + run(digits, 10, 12) + "-" + run(mixed, 20, 28), lambda: "AIza" + run(mixed + "_-", 35, 35), lambda: "eyJ" + run(mixed, 16, 30) + ".eyJ" + run(mixed, 20, 40) + "." + run(mixed + "_-", 24, 43), lambda: run(mixed, 28, 48), lambda: run(mixed + "+/", 32, 48) + "="])()

    def weak() -> str:
        """A secret only because of the name before it."""
        return r.choice([lambda: spoken(r.randint(2, 3)) + run(digits, 1, 4), lambda: spoken(r.randint(1, 3)) + run(digits, 1, 4), lambda: spoken(2).capitalize() + run(digits, 2, 4), lambda: spoken(1).capitalize() + r.choice("@!$#%&*") + spoken(1) + r.choice("@!$#%&*_-") + run(digits, 1, 4), lambda: run(low, 16, 30), lambda: spoken(r.randint(7, 10)), lambda: run(caps, 14, 30), lambda: run(low + digits, 8, 22), lambda: run("0123456789abcdef", 12, 23), lambda: "-".join(run(caps + digits, 4, 5) for _ in range(r.randint(3, 5))), lambda: "-".join([run(caps, 4, 4), run(digits, 4, 4), run(caps, 4, 4), run(digits, 4, 4)]), lambda: run(mixed, 10, 24), lambda: run(low, 5, 8) + "_" + run(mixed, 8, 16)])()

    def other() -> str:
        return r.choice([
            lambda: run(digits, 12, 19), lambda: " ".join(run(digits, 4, 4) for _ in range(4)), lambda: f"+{run(digits, 1, 2)} {run(digits, 2, 3)} {run(digits, 3, 4)} {run(digits, 4, 4)}", lambda: f"{run(digits, 3, 3)}-{run(digits, 3, 3)}-{run(digits, 4, 4)}", lambda: f"({run(digits, 3, 3)}) {run(digits, 3, 3)}-{run(digits, 4, 4)}",
            lambda: f"{spoken(2)}.{spoken(2)}{run(digits, 0, 3)}@{spoken(2)}.{r.choice(['com', 'org', 'net', 'example'])}", lambda: f"https://{spoken(2)}.org/{spoken(2)}/{run(digits, 2, 8)}?q={spoken(2)}", lambda: f"www.{spoken(3)}.com/{spoken(2)}-{spoken(2)}.html", lambda: f"/usr/{spoken(1)}/{spoken(2)}.py", lambda: f"{spoken(2)}-{run(digits, 1, 3)}.{run(digits, 1, 2)}.{run(digits, 1, 2)}", lambda: f"v{run(digits, 1, 2)}.{run(digits, 1, 2)}",
            lambda: f"20{run(digits, 2, 2)}-0{run('123456789', 1, 1)}-1{run('0123', 1, 1)}T12:30:00", lambda: f"{run(digits, 1, 2)}/{run(digits, 1, 2)}/19{run(digits, 2, 2)}", lambda: ".".join(run(digits, 1, 3) for _ in range(4)), lambda: spoken(r.randint(5, 9)), lambda: spoken(r.randint(5, 8)).capitalize(), lambda: spoken(4).upper(), lambda: spoken(r.randint(5, 11)).upper(), lambda: run("ACGT", 14, 70), lambda: " ".join(spoken(r.randint(1, 8)).upper() for _ in range(r.randint(2, 8))), lambda: spoken(r.randint(6, 11)).upper() + r.choice("!?.,"), lambda: f"INV-20{run(digits, 2, 2)}-{run(digits, 4, 6)}", lambda: f"{spoken(2)}{spoken(2).capitalize()}{spoken(1).capitalize()}({spoken(1)}{run(digits, 1, 1)})", lambda: f"{spoken(1)}_{spoken(2)}_{run(digits, 1, 3)}",
            lambda: f"DE{run(digits, 2, 2)} {run(digits, 4, 4)} {run(digits, 4, 4)} {run(digits, 4, 4)}", lambda: f"DE{run(digits, 20, 20)}", lambda: f"#{run('0123456789abcdef', 6, 6)}", lambda: f"{run(digits, 1, 3)},{run(digits, 3, 3)}.{run(digits, 2, 2)}", lambda: run("#*$%&|<>=-_~", 2, 12), lambda: "-".join(run("0123456789abcdef", k, k) for k in (8, 4, 4, 4, 12)), lambda: f"{spoken(2)}-{spoken(2)}-{spoken(2)}", lambda: f"<{spoken(1)} {spoken(1)}=\"{spoken(2)}\">",
        ])()

    named = "password passwd pwd passphrase secret token apikey api_key api-key key auth bearer credential credentials login Password PWD Secret Token".split()
    two = ["access key", "access token", "client secret", "private key", "api key", "auth token", "Authorization: Bearer", "bearer token", "login password"]
    out = []
    for _ in range(n):
        text, places, way = words(0, 6), [], r.random()
        text += " " if text else ""
        if way < 0.42:
            name = r.choice(named + two)
            value = weak() if r.random() < 0.65 else strong()
            text += name + r.choice([" ", " ", ": ", ":", "=", " = ", " is ", "='", '="', ': "', " -> ", " ('"])
        elif way < 0.55:
            value = strong()
            text += r.choice(["", "", "(", '"', "x: "])
        elif way < 0.75:  # key words in plain sentences
            text += r.choice(named + two).lower().replace("_", " ") + r.choice([" ", " ", ": ", " is ", " was ", ", "]) + r.choice([words(1, 4), other() + " " + word(), r.choice(common)])
            value = ""
        else:
            text += other() + r.choice(["", ",", "."]) + " " + other()
            value = ""
        if value:
            places.append((len(text), len(text) + len(value)))
            text += value
        after = words(0, 6)
        if way < 0.42 and r.random() < 0.08:  # a password in a link
            head, value = words(0, 3) + " " + r.choice(["postgres", "mysql", "https", "redis", "amqp"]) + f"://{spoken(2)}:", weak().replace("@", "").replace("/", "")
            text, places = head + value + f"@{spoken(2)}{r.choice(['', '.example.com', ':5432'])}/{spoken(1)}", [(len(head), len(head) + len(value))]
        elif way < 0.55 and r.random() < 0.06:  # a key of several lines
            kind = r.choice(["RSA PRIVATE KEY", "PRIVATE KEY", "EC PRIVATE KEY", "OPENSSH PRIVATE KEY"])
            text, places = f"-----BEGIN {kind}-----\n", []
            for size in [64] * r.randint(1, 5) + [r.randint(20, 64)]:
                places.append((len(text), len(text) + size))
                text += run(mixed + "+/", size, size) + "\n"
            text += f"-----END {kind}-----"
        elif not places and r.random() < 0.2 and not any(c.isdigit() for c in text):  # shouted prose
            text, after = text.upper(), after.upper()
        out.append((text + r.choice(["", "", ",", ".", '"', "'", ")", ";"]) + r.choice([" ", "\n"]) + after, places))
    return out


def line_tags(text: str, places: list[tuple[int, int]]) -> list[int]:
    tags = []
    for m in _TOKEN.finditer(text):
        inside = next((s for s, e in places if s <= m.start() and m.end() <= e), None)
        tags.append(OUTSIDE if inside is None else BEGIN if m.start() == inside else INSIDE)
    return tags


def _sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, values[:, k], n) for k in range(_TAGS)], axis=1)


@functools.cache
def trained() -> Chain:
    """The model, fitted on ``TRAINING_LINES`` made-up lines by steps up the log-likelihood of all of them (Adam); the same on each run."""
    chain = Chain()
    lines = training_lines(TRAINING_LINES)
    tokens = Tokens(chain.names, learning=True)
    texts = [text for text, _ in lines]
    at, sizes, _ = tokens.laid(texts)
    chain.named = np.zeros((len(chain.names), _TAGS))
    files = np.array([file_code(t, base_spans(t)) for t in texts])
    around = surroundings(tokens, at, sizes, files)
    gold = np.array([tag for text, places in lines for tag in line_tags(text, places)])
    of, which = np.repeat(np.arange(len(tokens.features)), [len(x) for x in tokens.features]), np.array([f for x in tokens.features for f in x])
    full = np.flatnonzero(sizes)
    keep = sizes[full]
    observed = np.eye(_TAGS)[gold]
    starts = np.cumsum(sizes) - sizes
    follows = np.ones(len(at), bool)
    follows[starts[full]] = False
    true_pairs = np.zeros((_TAGS, _TAGS))
    np.add.at(true_pairs, (gold[np.flatnonzero(follows) - 1], gold[follows]), 1)
    parts = chain.parts()
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, STEPS + 1):
        own = np.stack([np.bincount(of, chain.named[which, k], len(tokens.features)) for k in range(_TAGS)], axis=1)
        belief, pairs = beliefs(emissions(chain, own[at], around), chain.moves, keep)
        error = observed - belief
        by_token = _sums(at, error, len(own))
        slopes = [_sums(which, by_token[of], len(chain.named)), *(_sums(w, error, len(p)) for p, w in zip(parts[1:5], around[:4], strict=True))]
        for p, slope, m, v in zip(parts, [*slopes, true_pairs - pairs], first, second, strict=True):
            slope = slope / len(lines) - SHRINK * np.where(p > _NEVER / 2, p, 0)
            m += 0.1 * (slope - m)
            v += 0.01 * (slope * slope - v)
            p += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    chain.moves[OUTSIDE, INSIDE] = _NEVER
    return chain


class Tagger:
    """Tags whole texts, some at a time; made once in each task."""

    def __init__(self, chain: Chain) -> None:
        self.chain, self.tokens = chain, Tokens(chain.names)
        self.own, self.filled = np.zeros((1024, _TAGS)), 0

    def _own(self) -> np.ndarray:
        """Scores of the known tokens by their own features, those of new ones added."""
        features = self.tokens.features
        if len(features) < self.filled:
            self.filled = 0
        if len(features) > len(self.own):
            grown = np.zeros((2 * len(features), _TAGS))
            grown[: self.filled] = self.own[: self.filled]
            self.own = grown
        if new := features[self.filled :]:
            of, which = np.repeat(np.arange(len(new)), [len(x) for x in new]), np.array([f for x in new for f in x], np.int64)
            for k in range(_TAGS):
                self.own[self.filled : len(features), k] = np.bincount(of, self.chain.named[which, k], len(new))
            self.filled = len(features)
        return self.own

    def scores(self, texts: list[str], bases: list[list[Span]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.tokens.known) > VOCABULARY:
            self.filled = 0
        at, sizes, _ = self.tokens.laid(texts)
        files = np.array([file_code(t, b) for t, b in zip(texts, bases, strict=True)], np.int64)
        return emissions(self.chain, self._own()[at], surroundings(self.tokens, at, sizes, files)), sizes

    def tags(self, texts: list[str], bases: list[list[Span]]) -> list[np.ndarray]:
        scores, sizes = self.scores(texts, bases)
        full = sizes > 0
        tags = viterbi(scores, self.chain.moves, sizes[full])
        return np.split(tags, np.cumsum(sizes)[:-1])

    def spans(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """For each text all spans and the base spans, each by start, then kind. What the model tags stays only apart from base spans."""
        bases = [base_spans(t) for t in texts]
        out = []
        for text, base, tags in zip(texts, bases, self.tags(texts, bases) if texts else [], strict=True):
            found = [s for s in _tagged(text, tags) if not any(s[0] < b[2] and b[0] < s[2] for b in base)] if tags.any() else []
            out.append((sorted(base + found) if found else base, base))
        return out


def _tagged(text: str, tags: np.ndarray) -> list[Span]:
    """A span for each BEGIN, with the INSIDE tokens that follow it at once."""
    found: list[Span] = []
    open_ = False
    for m, tag in zip(_TOKEN.finditer(text), tags.tolist(), strict=True):
        if tag == BEGIN:
            found.append((m.start(), 3, m.end()))
        elif tag == INSIDE and open_:
            found[-1] = (found[-1][0], 3, m.end())
        open_ = tag == BEGIN or (tag == INSIDE and open_)
    return found


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _some_at_once(texts: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """The texts of a batch, about ``CHARACTERS_AT_ONCE`` characters at a time, with the place of the first."""
    part, size, first = [], 0, 0
    for i, text in enumerate(texts):
        value = text.as_py()
        part.append(value)
        size += len(value or "")
        if size >= CHARACTERS_AT_ONCE:
            yield first, part
            part, size, first = [], 0, i + 1
    if part:
        yield first, part


def secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_assign, n_access, n_hex, n_crf, base_sha256, spans) for each row; offsets are code points, end exclusive.

    Every token of a text is tagged: the whole text is one sequence, decoded exactly. A secret of the model holds no white space. What it finds on top of a base span is
    left out. Null text: like the empty one, no spans. Null doc_id: kept. Repeated rows: rows of their own. Empty table: empty result.
    Whole texts are read; equal starts stand by kind.
    """
    chain = trained()
    fields = [T.StructField(f"n_{k}", T.LongType()) for k in KINDS] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]

    def digests(batches: Iterator[pa.Array]) -> Iterator[list[tuple]]:
        tagger = Tagger(chain)
        for texts in batches:
            rows = []
            for _, part in _some_at_once(texts):
                for spans, base in tagger.spans([t or "" for t in part]):
                    n = [sum(s[1] == k for s in spans) for k in range(4)]
                    rows.append((*n, hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            yield rows

    return map_batches(docs, [F.col("doc_id"), F.xxhash64("text").alias("text_hash")], F.col("text"), digests, T.StructType(fields))


def redacted(text: str, spans: list[Span], mark: str) -> str:
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret in ``text`` replaced by ``mark`` and ``n_chars`` counted anew; overlapping spans are one. Null stays null."""
    chain = trained()

    def cleaned(batches: Iterator[pa.Array]) -> Iterator[list[tuple]]:
        tagger = Tagger(chain)
        for texts in batches:
            rows = []
            for _, part in _some_at_once(texts):
                for text, (spans, _) in zip(part, tagger.spans([t or "" for t in part]), strict=True):
                    clean = text if text is None or not spans else redacted(text, spans, mark)
                    rows.append((clean, None if clean is None else len(clean)))
            yield rows

    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return map_batches(docs, [F.col(f"`{c}`") for c in others], F.col("text"), cleaned, T.StructType(fields)).select(*(f"`{c}`" for c in docs.columns))
