"""Averaged perceptrons: a plain multi-class one and a character editor. Both train on bounded samples on the driver."""

from __future__ import annotations

import heapq
import random
from collections import defaultdict


class Averaged:
    """Multi-class averaged perceptron over string features."""

    def __init__(self) -> None:
        self.weights: dict[str, dict[str, float]] = {}
        self.labels: list[str] = []

    def scores(self, features: list[str]) -> dict[str, float]:
        out = dict.fromkeys(self.labels, 0.0)
        for f in features:
            for label, w in self.weights.get(f, {}).items():
                out[label] = out.get(label, 0.0) + w
        return out

    def predict(self, features: list[str]) -> str:
        s = self.scores(features)
        return max(self.labels, key=lambda x: (s[x], x))

    def train(self, data: list, rounds: int = 5, seed: int = 1, split: bool = False) -> Averaged:
        """data: (features, label); with `split`, ((features, labels allowed beside "keep"), label)."""
        self.labels = sorted({y for _, y in data})
        w: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
        total: dict[tuple[str, str], float] = defaultdict(float)
        since: dict[tuple[str, str], int] = defaultdict(int)
        t = 0
        order = list(range(len(data)))
        rng = random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for i in order:
                features, y = data[i]
                options = self.labels
                if split:
                    features, options = features[0], ("keep", *features[1])
                t += 1
                s = dict.fromkeys(options, 0.0)
                for f in features:
                    for label, v in w[f].items() if f in w else ():
                        if label in s:
                            s[label] += v
                guess = max(options, key=lambda x: (s[x], x))
                if guess != y:
                    for f in features:
                        for label, d in ((y, 1.0), (guess, -1.0)):
                            k = (f, label)
                            total[k] += (t - since[k]) * w[f][label]
                            since[k] = t
                            w[f][label] += d
        for f, per in w.items():
            self.weights[f] = {}
            for label, v in per.items():
                average = (total[f, label] + (t - since[f, label]) * v) / max(t, 1)
                if average:
                    self.weights[f][label] = average
        return self


def edit(noisy: str, clean: str) -> tuple[int, str, str] | None:
    """(place, wrong, right) if the two differ in one place by one or two characters a side: replace, delete (right is shorter) or
    insert (right is longer); None if they differ otherwise."""
    a = 0
    while a < min(len(noisy), len(clean)) and noisy[a] == clean[a]:
        a += 1
    b = 0
    while b < min(len(noisy), len(clean)) - a and noisy[-1 - b] == clean[-1 - b]:
        b += 1
    wrong, right = noisy[a : len(noisy) - b], clean[a : len(clean) - b]
    if not wrong and right and a:  # an insertion belongs to the character before it
        a, wrong, right = a - 1, noisy[a - 1], noisy[a - 1] + right
    return (a, wrong, right) if 1 <= len(wrong) <= 2 and len(right) <= 2 else None


#: A line end with the hyphen before it, and a blank between letters, as characters that the editor reads.
BREAK, BLANK = "\u23ce", " "


class Editor:
    """At each place of a word an operation: keep a character, or write something else for the next one or two. A line end (`BREAK`) is read as
    one character, for which nothing (the halves join) or a hyphen is written; a blank between letters is kept or deleted."""

    def __init__(self) -> None:
        self.model = Averaged()
        self.operations: dict[str, list[str]] = {}

    @staticmethod
    def features(word: str, i: int) -> list[str]:
        w = f"^^{word}$$"
        p, c, n = w[i + 1], w[i + 2], w[i + 3]
        return [f"c{c}", f"p{p}{c}", f"n{c}{n}", f"b{p}{c}{n}", f"l{w[i]}{p}{c}", f"r{c}{n}{w[i + 4]}", f"x{c}{'a' if n.isalpha() else n}{'a' if p.isalpha() else p}"]

    @classmethod
    def break_features(cls, a: str, b: str, joined: int, compound: int) -> list[str]:
        """The characters about the line end, and how often the joined word and the compound stand unbroken elsewhere."""
        j, h = min(joined.bit_length(), 12), min(compound.bit_length(), 12)
        return [*cls.features(a + BREAK + b, len(a)), f"j{j}", f"h{h}", f"h>j{compound > joined}", f"j>h{joined > compound}", f"h>4j{compound > 4 * joined}", f"j>4h{joined > 4 * compound}"]

    @staticmethod
    def blank_features(letters: str, i: int) -> list[str]:
        """The letters about a blank before letter i, the blanks between them left out."""
        w = f"^^^{letters}$$$"
        a, b = w[i : i + 3], w[i + 3 : i + 6]
        return [f"c{BLANK}", *(f"<{a[-k:]}" for k in (1, 2, 3)), *(f">{b[:k]}" for k in (1, 2, 3)), f"={a[-1]}{b[0]}", f"={a[-2:]}{b[0]}", f"={a[-1]}{b[:2]}", f"={a[-2:]}{b[:2]}"]

    def at(self, word: str, i: int) -> list[tuple[str, str]]:
        """The learnt operations that can apply here."""
        return [(x, y) for x in (word[i], word[i : i + 2]) for y in self.operations.get(x, ()) if len(x) <= len(word) - i]

    def train(self, pairs: list[tuple[str, str]], words: list[str], breaks: list[tuple[str, str, int, int, str]] = (), apart: list[list[str]] = (), share: float = 0.0015, support: int = 3) -> Editor:
        """pairs: (noisy, clean); words: correct ones; breaks: (half, half, count joined, count as a compound, "" or "-"); apart: words in a row,
        whose letters are read apart. An operation is learnt if at least `support` pairs, and this share of all, show it: misreadings repeat, other
        likenesses between words scatter. Two pairs do if it reads a sign that no correct word holds, or reverses a learnt one."""
        rows = [(u, *e) for u, v in pairs if (e := edit(u, v)) is not None]
        # a word that goes on where the noisy one ends was cut off, not misread
        rows = [(u, i, x, y) for u, i, x, y in rows if not (i + len(x) == len(u) and len(y) > len(x) and y.startswith(x))]
        seen: dict[tuple[str, str], int] = defaultdict(int)
        for _, _, wrong, right in rows:
            seen[wrong, right] += 1
        ordinary = {c for w in words for c in w}
        least = max(support, share * len(rows))
        operations: dict[str, list[str]] = defaultdict(list)
        for (x, y), k in sorted(seen.items()):
            if k >= least or (k >= 2 and (not set(x) <= ordinary or seen.get((y, x), 0) >= least)):
                operations[x].append(y)
        self.operations = dict(operations)
        data = []
        for u, place, wrong, right in rows:
            if right in self.operations.get(wrong, ()):
                data += [(self.features(u, i), f"{wrong}>{right}" if i == place else "keep", self.at(u, i)) for i in range(len(u)) if self.at(u, i)]
        for w in words:
            data += [(self.features(w, i), "keep", self.at(w, i)) for i in range(len(w)) if self.at(w, i)]
        data += [(self.break_features(a, b, j, h), f"{BREAK}>{right}", [(BREAK, ""), (BREAK, "-")]) for a, b, j, h, right in breaks]
        for row in apart:
            starts, letters = {sum(map(len, row[:k])) for k in range(len(row))}, "".join(row)
            data += [(self.blank_features(letters, i), "keep" if i in starts else f"{BLANK}>", [(BLANK, "")]) for i in range(1, len(letters))]
        self.model.train([((f, tuple(f"{x}>{y}" for x, y in ops)), y) for f, y, ops in data], rounds=4, split=True)
        return self

    def joins(self, a: str, b: str, joined: int, compound: int) -> bool:
        """Whether the halves of a word become one word; else the line end is read as the compound's own hyphen."""
        s = self.model.scores(self.break_features(a, b, joined, compound))
        return s.get(f"{BREAK}>", 0.0) > s.get(f"{BREAK}>-", 0.0)

    def closing(self, letters: str) -> list[float]:
        """For each place between letters that stand apart, the gain of deleting the blank there."""
        got = (self.model.scores(self.blank_features(letters, i)) for i in range(1, len(letters)))
        return [s.get(f"{BLANK}>", 0.0) - s.get("keep", 0.0) for s in got]

    def proposals(self, word: str, most: int = 16, changes: int = 3) -> list[tuple[str, float]]:
        """The edited forms of a word, itself left out, with their scores against keeping every character: every form of one change, and of those
        with more changes (up to `changes`) the ones that `most` best partial forms at each place lead to."""
        places = []
        for i in range(len(word)):
            if ops := self.at(word, i):
                got = self.model.scores(self.features(word, i))
                places.append((i, [(x, y, got.get(f"{x}>{y}", 0.0) - got.get("keep", 0.0)) for x, y in ops]))
        if not places:
            return []
        best: dict[str, float] = {}
        for i, ops in places:
            for x, y, gain in ops:
                o = word[:i] + y + word[i + len(x) :]
                best[o] = max(gain, best.get(o, -1e9))
        if len(places) > 1:
            by = dict(places)
            beams: list[list[tuple[float, str, int]]] = [[] for _ in range(len(word) + 1)]
            beams[0] = [(0.0, "", 0)]
            for i, c in enumerate(word):
                beam = beams[i] if len(beams[i]) <= most else heapq.nlargest(most, beams[i])
                beams[i + 1] += [(s, o + c, k) for s, o, k in beam]
                for x, y, gain in by.get(i, ()):
                    beams[i + len(x)] += [(s + gain, o + y, k + 1) for s, o, k in beam if k < changes]
            for s, o, k in beams[-1]:
                if k:
                    best[o] = max(s, best.get(o, -1e9))
        best.pop(word, None)
        return sorted(best.items(), key=lambda z: -z[1])
