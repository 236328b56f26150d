"""Problem 1: freely typed values mapped to a canonical list by a trie searched with a Levenshtein automaton.

The list is compiled to a trie of alias paths: every entry's name and known
aliases, each word in both scripts (word pairs and syllables are learned from
the list's own aliases), in the order as written and turned round.  A typed
value is levelled (width, case, invisible and look-alike characters,
decoration such as legal forms and versions) and run through the trie by a
bit-parallel Levenshtein automaton, which gives all entries within a distance
that grows with the value's length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Romanisation of Hangul initials, vowels and finals, by their order in Unicode.
_INITIALS = "g kk n d tt r m b pp s ss * j jj ch k t p h".replace("*", "").split(" ")
_VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
_FINALS = "* k k k n n n t l l l l l l l l m p p t t ng t t k t p t".replace("*", "").split(" ")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("аеорсухіѕјкмтнвгԁӏοανρτικυ", "aeopcyxisjkmthbrdloavptiku")
_HIDDEN = re.compile("[\\u00ad\\u034f\\u061c\\u115f\\u1160\\u17b4\\u17b5\\u180b-\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u206f\\u3164\\ufe00-\\ufe0f\\ufeff\\uffa0]")
# Decoration that says nothing about the item: legal forms, forms of address, states of an office, versions.
_LEGAL = re.compile(r"\((?:주|유|株|acting|interim|korea|kr|한국|대한민국)\)|/\s*담당자?\b|(?<=\w )i{2,3}$|주식회사|유한회사|(?<![^\W_])(?:co\.?\s*,?\s*ltd|inc|corp|corporation|ltd|llc|gmbh|ag|plc|company|limited|mr/ms|mrs?|ms|dr|acting|interim)(?![^\W_])\.?")
_VERSION = re.compile(r"(?<![^\W_])(?:v|ver|version|rel|release|버전|r)?[.\s]*\d+(?:\.\d+)*(?:\.x)?(?:버전|판)?(?![^\W_])")
_WORDS = re.compile(r"[^\W_]+")


def romanize(text: str) -> str:
    """Hangul syllables in Latin letters; other characters stay."""
    out = []
    for c in text:
        k = ord(c) - 0xAC00
        out.append(_INITIALS[k // 588] + _VOWELS[k % 588 // 28] + _FINALS[k % 28] if 0 <= k < 11172 else c)
    return "".join(out)


def level(text: str) -> str:
    """Width, case, invisible and look-alike characters levelled; Hangul composed."""
    if text.isascii() and text.isprintable():  # nothing but the case to level
        return text.lower()
    text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    return "".join(c for c in text.casefold().translate(_LOOKALIKE) if unicodedata.category(c) not in ("Cc", "Cf") or c in "\t\n\r")


def squeeze(text: str) -> str:
    """Key of a levelled text: letters and digits only, Hangul as single letters (jamo)."""
    letters = "".join(_WORDS.findall(text))
    return letters if letters.isascii() else unicodedata.normalize("NFD", letters)


def distance_for(length: int) -> int:
    """Edits allowed for a key of this length."""
    return 0 if length < 4 else 1 if length < 7 else 2 if length < 12 else 3


class _Node:
    """A place in a trie: the ways on, the entries that end here, and the fewest and most characters to an end below."""

    __slots__ = ("kids", "ids", "shortest", "longest")

    def __init__(self):
        self.kids: dict[str, _Node] = {}
        self.ids: tuple[int, ...] = ()
        self.shortest, self.longest = 0, 1 << 30


def _compile(keys: Iterable[tuple[str, int]]) -> _Node:
    root = _Node()
    for key, i in keys:
        node = root
        for c in key:
            after = node.kids.get(c)
            if after is None:
                after = node.kids[c] = _Node()
            node = after
        if i not in node.ids:
            node.ids += (i,)
    return root


def _bound(root: _Node) -> _Node:
    """Notes at each place the fewest and most characters to an end below."""
    places = [root]
    for node in places:
        places.extend(node.kids.values())
    for node in reversed(places):  # ends before the ways to them
        node.shortest = min([0] * bool(node.ids) + [k.shortest + 1 for k in node.kids.values()], default=0)
        node.longest = max((k.longest + 1 for k in node.kids.values()), default=0)
    return root


class CanonicalTrie:
    """The compiled list; ``entries``: (id, name, aliases or None)."""

    def __init__(self, entries: list[tuple[int, str, list[str] | None]]):
        names = [(i, level(n), [level(a) for a in (al or []) if a]) for i, n, al in entries if n]
        self.words: dict[str, set[str]] = {}  # word -> its forms in the other script
        syllables: dict[str, set[str]] = {}
        heads: set[str] = set()
        for _, name, aliases in names:
            for form in (name, *aliases):
                for w in _WORDS.findall(form):
                    self.words.setdefault(w, set())
                first = _WORDS.findall(form)[:1]
                heads.update(first)
            for alias in aliases:
                a, b = _WORDS.findall(name), _WORDS.findall(alias)
                if len(a) == len(b) and _korean(name) != _korean(alias):
                    for x, y in zip(a, b):
                        self.words[x].add(y)
                        self.words[y].add(x)
        for w in list(self.words):
            for v in {w, *self.words[w]}:
                if _korean(v) and any(romanize(v) == u for u in ({w} | self.words[w])):
                    for c in v:
                        syllables.setdefault(romanize(c), set()).add(c)
        for w in heads:  # entries without an alias: syllables of Korean heads too
            if _korean(w) and not self.words[w]:
                for c in w:
                    syllables.setdefault(romanize(c), set()).add(c)
        self.syllables = syllables
        for w in heads:
            if not self.words[w]:
                self.words[w] |= {romanize(w)} if _korean(w) else set(self._spellings(w))
                for v in list(self.words[w]):
                    self.words.setdefault(v, set()).add(w)
        self.forms = {w: {w, *self.words[w]} for w in self.words}
        self.short: dict[str, list[str]] = {}  # words after the first, by first letter, for abbreviations
        for _, name, aliases in names:
            for form in (name, *aliases):
                ws = _WORDS.findall(form)
                for w in ws[1:] + (ws[:1] if len(ws) > 2 else []):
                    if w not in self.short.setdefault(w[0], []):
                        self.short[w[0]].append(w)
        self.exact: dict[str, set[int]] = {}
        self.of: dict[int, list[set[str]]] = {}
        self.having: dict[str, set[int]] = {}  # entries that have a word, in any of its forms
        for i, name, aliases in names:
            self.of[i] = [{v for x in _WORDS.findall(f) for v in self.forms[x]} for f in (name, *aliases)]
            for w in set().union(*self.of[i]):
                self.having.setdefault(w, set()).add(i)
            for form in (name, *aliases):
                words = _WORDS.findall(form)
                for order in {tuple(words), tuple(words[-1:] + words[:-1]), tuple(words[1:] + words[:1])}:
                    for path in product(*(sorted(self.forms[w]) for w in order)):
                        self.exact.setdefault(squeeze("".join(path)), set()).add(i)
        self.keys: dict[int, list[str]] = {}
        for key, ids in self.exact.items():
            for i in ids:
                self.keys.setdefault(i, []).append(key)
        self.root = _bound(_compile((key, i) for key, ids in self.exact.items() for i in ids))
        self.back = _bound(_compile((key[::-1], i) for key, ids in self.exact.items() for i in ids))  # the same from the other end
        self.below: dict[str, _Node] = {}  # the tries of the entries that have a word, made when first searched
        self.known: dict[tuple[str, ...], int] = {}  # levelled values that were matched already
        self.reach = max(map(len, self.exact), default=0) + distance_for(1 << 20)

    def _spellings(self, word: str, at: int = 0) -> Iterator[str]:
        """All Hangul spellings of a Latin word by the list's own syllables."""
        if at == len(word):
            yield ""
        for n in (4, 3, 2, 1):
            for c in sorted(self.syllables.get(word[at : at + n], ())) if at + n <= len(word) else ():
                for rest in self._spellings(word, at + n):
                    yield c + rest

    def well_formed(self, word: str) -> bool:
        """Whether a word is built of the list's own syllables throughout, so that it is a name of its own rather than a slip."""
        if _korean(word):
            return len(word) > 1 and all(c in self.syllables.get(romanize(c), ()) for c in word)
        return len(word) > 3 and next(self._spellings(word), None) is not None

    def expanded(self, form: str) -> list[str]:
        """Readings of a form with abbreviated words (Ins., Mgr, Eng.) written out, where any is."""
        options = []
        for w in form.split():
            full = [v for v in self.short.get(w[0], ()) if _abbreviates(w, v)] if len(w) >= 2 and w not in self.forms else []
            options.append(full or [w])
        if all(len(o) == 1 and o[0] == w for o, w in zip(options, form.split())):
            return []
        return [" ".join(x) for x in product(*options)]

    def search(self, key: str, most: int, root: _Node | None = None) -> dict[int, int]:
        """All entries (below ``root``, where given) within ``most`` edits of the key (insertions, deletions, changes, exchanges of neighbours), with their distance.

        The whole list is searched from both ends: of up to ``most`` edits
        either at most half lie in the key's first half, or fewer than half in
        its second, so few ways are open near the root of either trie.
        """
        if root is not None or not most:
            return self._walk(key, most, root or self.root, most)
        early = (most - 1) // 2
        found = self._walk(key, most, self.root, early)
        for i, e in self._walk(key[::-1], most, self.back, most - 1 - early).items():
            found[i] = min(e, found.get(i, 99))
        return found

    @staticmethod
    def _walk(key: str, most: int, root: _Node, early: int) -> dict[int, int]:
        """Entries within ``most`` edits, of which at most ``early`` lie in the first half of the key.

        Bit j of state e says that j characters of the key may be consumed with
        e edits; the states move along the trie, and a branch ends when all
        are empty, or what is left of the key differs from every way to the
        end of the branch by more characters than there are edits.
        """
        n = len(key)
        masks: dict[str, int] = {}
        for j, c in enumerate(key):
            masks[c] = masks.get(c, 0) | 1 << j
        full, goal = (1 << n + 1) - 1, 1 << n
        late = full & ~((1 << n // 2) - 1)
        allowed = [full if e <= early else late for e in range(most + 1)]
        start = [1]
        for e in range(most):
            start.append((start[-1] | start[-1] << 1) & allowed[e + 1])
        found: dict[int, int] = {}
        stack = [(root, tuple(start), None, 0)]
        while stack:
            node, states, before, mask_before = stack.pop()
            for c, child in node.kids.items():
                m = masks.get(c, 0)
                last = any_state = (states[0] & m) << 1
                new = [last]
                for e in range(1, most + 1):
                    low = states[e - 1]
                    s = (states[e] & m) << 1 | low | low << 1 | last << 1
                    if before is not None:  # exchange of neighbours: the key has c and the parent's character in turn
                        s |= (before[e - 1] & m & mask_before >> 1) << 2
                    last = s & allowed[e]
                    any_state |= last
                    new.append(last)
                if not any_state or not any_state >> max(0, n - child.longest - most) or not any_state & (1 << max(0, n - child.shortest + most + 1)) - 1:
                    continue
                if child.ids:
                    for e, s in enumerate(new):
                        if s & goal:
                            for i in child.ids:
                                if found.get(i, 99) > e:
                                    found[i] = e
                            break
                if child.kids:
                    stack.append((child, tuple(new), states, m))
        return found

    def _root_for(self, words: list[str]) -> _Node | None:
        """Trie of the entries that may be meant: those with the rarest of the typed words that the list has.

        None where no entry can be: a typed word is a name of its own, built
        of the list's syllables but not in it, or no entry has all the words.
        """
        known = [w for w in words if w in self.forms]
        if any(w not in self.forms and self.well_formed(w) for w in words):
            return None
        if not known:
            return self.root
        if not set.intersection(*(self.having[w] for w in known)):  # no entry has all of them
            return None
        rarest = min(known, key=lambda w: (len(self.having[w]), w))
        if rarest not in self.below:
            self.below[rarest] = _compile((key, i) for i in sorted(self.having[rarest]) for key in self.keys[i])
        return self.below[rarest]

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(entry, distance) of all entries within the length-dependent distance of a typed value, closest first."""
        best: dict[int, int] = {}
        for form in typed_forms(text):
            key = squeeze(form)
            for i, e in self.search(key, distance_for(len(key))).items():
                best[i] = min(e, best.get(i, 99))
        return sorted(best.items(), key=lambda x: (x[1], x[0]))

    def meaning(self, text: str | None) -> int:
        """The entry that a typed value means, or 0.

        An exact key decides; else the one closest entry counts, unless the
        value says something else: it holds a word of the list, or a name
        built of the list's syllables, that the entry has not.
        """
        if not text:
            return 0
        forms = tuple(f for f in typed_forms(text) if len(squeeze(f)) <= self.reach)  # a longer one is within the distance of no key
        if forms not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[forms] = self._meaning_of(forms)
        return self.known[forms]

    def _meaning_of(self, forms: tuple[str, ...]) -> int:
        forms += tuple(x for f in forms for x in self.expanded(f))
        for form in forms:
            hit = self.exact.get(squeeze(form))
            if hit:
                return next(iter(hit)) if len(hit) == 1 else 0
        for form in forms:
            key = squeeze(form)
            words = _WORDS.findall(form)
            root = self._root_for(words) if distance_for(len(key)) else None
            if root is None:
                continue
            found = self.search(key, distance_for(len(key)), None if root is self.root else root)
            kept = [(e, i) for i, e in found.items() if e and any(self._fits(words, has) for has in self.of[i])]
            least = min(kept, default=(0, 0))[0]
            nearest = [i for e, i in kept if e == least]
            if len(nearest) == 1:  # as near to two: it can't be told
                return nearest[0]
        return 0

    def _fits(self, words: list[str], has: set[str]) -> bool:
        """Whether no typed word is another word of the list or another name than the entry's, and no single word carries three edits."""
        off = [w for w in words if w not in has]
        if any(w in self.forms or self.well_formed(w) for w in off):
            return False
        if len(words) < 2 or len(off) != 1:
            return True
        key = squeeze(off[0])
        return min(edits(key, squeeze(h)) for h in has) < 3


def edits(a: str, b: str) -> int:
    """Edits between two short keys: insertions, deletions, changes and exchanges of neighbours."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, last[j - 2] + 1)
            row.append(d)
    return row[-1]


def _abbreviates(short: str, word: str) -> bool:
    """Whether ``short`` is a beginning or a consonant skeleton of ``word``."""
    if len(short) >= len(word) - 1:
        return False
    at = 0
    for c in short:
        at = word.find(c, at) + 1
        if not at:
            return False
    return word.startswith(short) or (word[0] == short[0] and not set(short[1:]) & set("aeiou"))


def _korean(text: str) -> bool:
    return any("가" <= c <= "힣" for c in text)


def typed_forms(text: str) -> list[str]:
    """Levelled readings of a typed value, the plainest last: as typed, and without decoration."""
    whole = level(text).strip()
    bare = _VERSION.sub(" ", _LEGAL.sub(" ", whole))
    out = []
    for form in (whole, bare):
        form = " ".join(_WORDS.findall(form))
        if form and form not in out:
            out.append(form)
    return out


@lru_cache(maxsize=2)
def _shared_trie(entries: _Entries) -> CanonicalTrie:
    """The compiled list, once per worker process, whatever the number of its tasks."""
    return CanonicalTrie(entries.rows)


class _Entries:
    """The list as it is sent along; told apart by its digest alone."""

    def __init__(self, rows: list[tuple]):
        self.rows = rows
        self.digest = hashlib.sha256(repr(rows).encode()).hexdigest()

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Entries) and self.digest == other.digest

    def __hash__(self) -> int:
        return hash(self.digest)


def _share_list(canon: DataFrame, most_entries: int) -> Broadcast:
    rows = canon.where(F.col("canon_id").isNotNull()).select("canon_id", "canonical_name", "known_aliases").limit(most_entries + 1).collect()
    if len(rows) > most_entries:
        raise ValueError(f"the list has more than {most_entries} entries")
    entries = sorted((r[0], r[1], list(r[2]) if r[2] is not None else None) for r in rows)
    return canon.sparkSession.sparkContext.broadcast(_Entries(entries))


def candidate_entries(entities: DataFrame, canon: DataFrame, most_entries: int = 100_000) -> DataFrame:
    """``(value, canon_id, distance)``: for each distinct typed name or alias all entries within the length-dependent distance.

    Values without an entry in reach have one row with null for both.  Null
    values are left out; every row of ``entities`` counts, not only the
    latest.  Equal values are combined before the shuffle and searched once.
    """
    shared = _share_list(canon, most_entries)
    typed = entities.select(F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("value")).where(F.col("value").isNotNull()).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _shared_trie(shared.value)
        for batch in batches:
            values, ids, distances = [], [], []
            for value in batch.column(0).to_pylist():
                for i, e in trie.candidates(value) or [(None, None)]:
                    values.append(value)
                    ids.append(i)
                    distances.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(ids, pa.int64()), pa.array(distances, pa.int32())], names=["value", "canon_id", "distance"])

    return typed.mapInArrow(run, "value string, canon_id bigint, distance int")


def map_entities(entities: DataFrame, canon: DataFrame, most_entries: int = 100_000) -> DataFrame:
    """``(entity_id, canon_id, matched_by)``: for each distinct entity the list item it means, or 0.

    The latest row of an entity counts (ties by the greatest name); its name
    comes first, its aliases in order where the name means nothing.  Null and
    blank names and aliases mean nothing; rows without an id are no entities.
    The list goes to every task, so it may have at most ``most_entries`` rows
    (checked); entities are one aggregation by id and one pass.
    """
    shared = _share_list(canon, most_entries)
    best = F.max(F.struct("updated_at", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))).alias("_best")
    latest = entities.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(best).select("entity_id", "_best.name", "_best.aliases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _shared_trie(shared.value)
        known: dict[str, int] = {}

        def meaning(text: str | None) -> int:
            if not text:
                return 0
            if text not in known:
                if len(known) > 200_000:
                    known.clear()
                known[text] = trie.meaning(text)
            return known[text]

        for batch in batches:
            ids, by = [], []
            for name, aliases in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                hit, how = meaning(name), "name"
                if not hit:
                    hit, how = next(((m, "alias") for a in aliases if (m := meaning(a))), (0, None))
                ids.append(hit)
                by.append(how)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(by, pa.string())], names=["entity_id", "canon_id", "matched_by"])

    return latest.mapInArrow(run, "entity_id string, canon_id bigint, matched_by string")
