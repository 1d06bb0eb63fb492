"""A lexicon of abusive terms, learned from labelled rows, and the automaton that finds its terms misspelled.

The terms stand in a trie. A Levenshtein automaton runs over the trie as it reads a word: each state is the
set of (trie node, edits so far) pairs that the read letters can reach. States are numbered as they appear and
letters that no branch of a state asks for share one transition, so a word costs one lookup a letter and most
words leave the trie after a few.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from heapq import nsmallest

WORD = re.compile(r"[^\W\d_]+")
#: How a term is written: a stem, or a whole word with END; MORE once for each further time a text must have it.
END, MORE = "$", "+"
SHORTEST, LONGEST, TIMES = 4, 10, 3
STATES = 50_000


def stem(term: str) -> str:
    return term.rstrip(MORE).removesuffix(END)


def times(term: str) -> int:
    """How often a text must have the term for it to count."""
    return 1 + len(term) - len(term.rstrip(MORE))


def edits(term: str) -> int:
    """Whole words of five letters may differ by one, of nine by two; stems of seven letters by one."""
    if times(term) > 1:
        return 0
    length = len(stem(term))
    if term.endswith(END):
        return 2 if length >= 9 else 1 if length >= 5 else 0
    return 1 if length >= 7 else 0


class Automaton:
    """Finds the terms' stems (words begin with them) and whole words, each with its own number of edits."""

    def __init__(self, terms: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[str, int]]] = [[]]
        self.allowed = [0]  # the most edits any term below the node may have
        for term in terms:
            node, most = 0, edits(term)
            self.allowed[0] = max(self.allowed[0], most)
            for letter in stem(term):
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.allowed.append(0)
                node = self.children[node][letter]
                self.allowed[node] = max(self.allowed[node], most)
            self.ends[node].append((term, most))
        self._reset()

    def _reset(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.letters: list[frozenset[str]] = []
        self.found: list[tuple[list, list]] = []
        self._number(frozenset())
        self.start = self._closed({(0, 0)})

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
            self.letters.append(frozenset(x for node, _ in state for x in self.children[node]))
            hits = [(used, -len(stem(t)), t) for node, used in state for t, most in self.ends[node] if used <= most]
            whole = [h for h in hits if END in h[2]]
            self.found.append((whole, [h for h in hits if END not in h[2]]))
        return self.numbers[state]

    def _closed(self, pairs: set[tuple[int, int]]) -> int:
        """The state of the pairs and of those that leave out letters of the trie."""
        least: dict[int, int] = {}
        open_ = sorted(pairs, key=lambda p: p[1])
        while open_:
            node, used = open_.pop(0)
            if used > self.allowed[node] or least.get(node, used + 1) <= used:
                continue
            least[node] = used
            open_ += [(child, used + 1) for child in self.children[node].values()]
        return self._number(frozenset(least.items()))

    def _move(self, state: int, letter: str) -> int:
        pairs: set[tuple[int, int]] = set()
        for node, used in self.states[state]:
            pairs.add((node, used + 1))
            for wanted, child in self.children[node].items():
                pairs.add((child, used + (wanted != letter)))
        return self._closed(pairs)

    def find(self, word: str) -> tuple[str, int] | None:
        """The nearest term of the word and its edits: fewest edits, then the longest term, then by letters."""
        if len(self.states) > STATES:
            self._reset()
        best, state = None, self.start
        for letter in word:
            key = letter if letter in self.letters[state] else ""
            after = self.moves[state].get(key)
            if after is None:
                after = self.moves[state][key] = self._move(state, key)
            state = after
            if not state:
                break
            if self.found[state][1]:
                best = min([*self.found[state][1], *([best] if best else [])])
        if state and self.found[state][0]:
            best = min([*self.found[state][0], *([best] if best else [])])
        return None if best is None else (best[2], best[0])


def _units(words: Counter[str], known: set[str] | None = None) -> set[str]:
    """Terms a text supports; with ``known`` (closed under stems), those of it only."""
    counts: Counter[str] = Counter()
    for word, n in words.items():
        if len(word) < SHORTEST:
            continue
        for size in range(SHORTEST, min(len(word), LONGEST) + 1):
            if known is not None and word[:size] not in known:
                break
            counts[word[:size]] += n
        if known is None or word + END in known:
            counts[word + END] += n
    return {u + MORE * m for u, n in counts.items() for m in range(min(n, TIMES)) if m == 0 or not u.endswith(END)}


def learn(rows: list[tuple[str, int]], most_terms: int) -> list[str]:
    """Terms of the positive texts.

    Support is counted over groups of texts that share their three smallest words by hash, so that copies of
    one text count about once. A term needs support that chance would give less than one term in ten tries, and nine
    tenths of its texts positive. Of the stems along a word the longest that keeps the support is taken, and
    a term that must repeat only where no term that need not says as much.
    """
    import xxhash

    def words_of(text: str) -> Counter[str]:
        return Counter(WORD.findall(text.lower()))

    groups: dict[str, list[int]] = defaultdict(list)
    for number, (text, _) in enumerate(rows):
        words = words_of(text)
        if words:
            groups["".join(nsmallest(3, words, key=lambda w: (xxhash.xxh3_64_intdigest(w), w)))].append(number)
    support: Counter[str] = Counter()
    positive: Counter[str] = Counter()
    groups_positive = [[i for i in members if rows[i][1]] for members in groups.values()]
    groups_positive = [members for members in groups_positive if members]
    for members in groups_positive:
        together: set[str] = set()
        for i in members:
            found = _units(words_of(rows[i][0]))
            positive.update(found)
            together |= found
        support.update(together)
    if not positive or len(groups_positive) == len(groups):
        return []
    share = max(len(groups_positive) / len(groups), 1e-4)
    least = max(3, math.ceil(math.log(10 * len(support)) / math.log(1 / share)))
    strong = {u: n for u, n in support.items() if n >= least}
    positive = Counter({u: positive[u] for u in strong})
    del support
    good, negative = dict(strong), Counter()
    others = [text for text, label in rows if not label]
    for start in range(0, len(others), 500):  # a unit that has met too many of the others is not looked for again
        known = {stem(u)[:n] for u in good for n in range(SHORTEST, len(stem(u)) + 1)} | {u.rstrip(MORE) for u in good}
        for text in others[start:start + 500]:
            negative.update(u for u in _units(words_of(text), known) if u in good)
        good = {u: n for u, n in good.items() if positive[u] >= 9 * negative[u]}
    longer: dict[tuple[str, int], list[str]] = defaultdict(list)
    for unit in good:
        shorter = stem(unit) if END in unit else stem(unit)[:-1]
        longer[shorter, times(unit)].append(unit)
    terms: dict[str, int] = {}
    chosen: set[str] = set()
    for unit in sorted(good, key=lambda u: (times(u), len(u), u)):
        own = stem(unit)
        if any(own[:n] in chosen for n in range(SHORTEST, len(own) + 1)):
            continue
        while END not in unit:  # a longer stem with nearly the same support says the same and is safer
            steps = [u for u in longer[stem(unit), times(unit)] if good[u] >= 0.8 * good[unit]]
            if not steps:
                break
            unit = max(steps, key=lambda u: (good[u], u))
        if not any(stem(unit)[:n] in chosen for n in range(SHORTEST, len(stem(unit)) + 1)):
            terms[unit] = good[unit]
            chosen.add(stem(unit))
    return sorted(terms, key=lambda t: (-terms[t], t))[:most_terms]
