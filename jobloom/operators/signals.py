"""What a text says on languages: phrases by one automaton, lists and conditions by a scanner over the words of a clause.

Names of languages are found first and stand as one sign each, so that one automaton holds the phrases around a name for all
languages alike. Phrases are read as parts of the text, wherever they begin. What no fixed phrase can hold (lists of any
length, conditions before and after a phrase) is read word by word, forwards, each word a bounded number of times. So a text costs time in
proportion to its length, and nothing recurses. Tables of phrases are values of `Forms`, and a caller may give others.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import cached_property, lru_cache

#: The sign that stands for a language in a phrase, and in a text that is read.
NAME = "\x01"

# How a language is mentioned, and what makes a mention a welcome one; every mention goes with every modifier.
MENTIONS = ["{l}", "{l} skills", "{l} language", "{l} language skills", "{l} proficiency", "proficiency in {l}", "knowledge of {l}", "{l} knowledge", "{l} communication", "communicate in {l}", "ability to communicate in {l}", "preferably also {l}", "{l} speaking"]
MODIFIERS = [
    "is preferred", "is desirable", "are desirable", "is highly desirable", "are highly desirable", "is nice to have", "is beneficial", "would be beneficial", "is considered an additional qualification", "is highly valuable",
    "is preferable", "are preferable", "is of added value", "are of added value", "is of great added value", "are of great added value", "will be value addition", "will be a value addition", "is a benefit", "would be a benefit",
]
# Other phrases of welcome.
WELCOME = ["as a plus in {l}", "as a plus: {l}", "nice to have: {l}", "nice to have {l}", "{l} – nice to have", "preferably {l}", "preferably in {l}", "preferably also {l}", "ideally {l}", "ideally in {l}", "ideally including {l}"]
# Phrases that ask for a language.
REQUIRED = [
    "{l} required", "{l} is required", "{l} is a must", "{l} is mandatory", "{l} – mandatory", "mandatory {l}", "{l} is essential", "{l} is necessary", "{l} is needed", "{l} is a requirement", "{l} fluency", "requires {l}", "must speak {l}", "must be {l}",
    "fluent {l}", "fluent in {l}", "fluent in spoken {l}", "fluent level in {l}", "fluent language skills in {l}", "fluency in {l}", "proficiency in {l}", "{l} proficiency", "proficient in {l}", "{l} proficient", "working proficiency in {l}", "{l} language proficiency",
    "working knowledge of {l}", "knowledge of {l}", "business {l}", "business-level {l}", "professional {l}", "{l} at a professional level", "{l} at professional level", "{l} at fluent level", "excellent {l}", "strong {l}", "communicative {l}", "{l} communicative",
    "{l} a1", "{l} a2", "{l} b1", "{l} b2", "{l} c1", "{l} c2", "a1 level of {l}", "a2 level of {l}", "b1 level of {l}", "b2 level of {l}", "c1 level of {l}", "c2 level of {l}", "level of {l}", "elementary {l}", "good {l}", "very good {l}", "good in {l}",
    "native level of {l}", "native {l}", "native in {l}", "{l} native", "{l}-native", "native-{l}", "mother tongue {l}", "{l} as mother tongue", "{l} as a mother tongue", "mother language {l}", "{l} as mother language", "{l} as a mother language",
    "{l} speaker", "{l} speaking", "speaks {l}", "speak {l}", "understand {l}", "communicate in {l}", "communicate fluently in {l}", "{l} communication skills", "communication skills in {l}", "{l} language skills", "{l} skills", "command of {l}", "ability in {l}",
    "understanding of {l}", "understanding of the {l} language", "good understanding of {l}", "good understanding of the {l} language", "written and spoken {l}", "spoken and written {l}", "{l} written and spoken", "{l} spoken and written",
    "working language is {l}", "working language: {l}", "the working language is {l}", "{l} working language", "both {l} and", "in both {l}", "both english and {l}", "{l} and english", "english and {l}", "english, and {l}", "english as well as {l}", "{l} as well as english",
    "english and also in {l}", "in english and also in {l}", "{l} and also in english", "in {l} and also in english", "{l}/english", "english/{l}", "in {l} and in english", "in english and in {l}", "in {l} and english", "{l} and in english", "discussions in {l}",
    "mastering {l}", "{l} is a prerequisite", "{l} is prerequisite", "basic {l}", "basic in {l}", "basic knowledge of {l}", "basic level of {l}", "some {l}", "at least {l}", "native speaker in {l}", "native speaker of {l}", "native speaker {l}",
    "communicate confidently in {l}", "english, {l}", "{l}, english", "english; {l}", "local language {l}", "in addition to {l}", "{l} as a secondary language", "{l} as a second language", "{l} as secondary language", "{l} as second language", "either {l}",
    "full professional proficiency in {l}", "professional proficiency in {l}", "full proficiency in {l}", "conversational {l}",
]
# What may stand after "knowledge of {l}" where the language itself is meant ("knowledge of Dutch law" is not).
OF_LANGUAGE = set("is are was were would will required needed mandatory essential language skills proficiency fluency spoken written level and or".split())
# Groups of languages by country, what they are called, and phrases that ask for one or welcome one.
GROUPS = {"nordic": ["FI", "SE", "NO", "DK", "IS"], "baltic": ["LV", "LT", "EE"]}
GROUP_NAMES = {"nordic": ["nordic", "scandinavian"], "baltic": ["baltic"]}
GROUP_REQUIRED = {
    "nordic": ["english and at least one {g} language", "proficient in one of the {g} languages", "proficiency in english and one of the {g} languages", "fluency in english and a {g} language", "in english and in one {g} language", "a {g} language is mandatory", "a {g} language is required", "at least one {g} language is required", "at least one {g} language is mandatory", "fluent in one {g} language", "{g} language skills are required", "{g} language skills are mandatory", "{g} language skills is required", "{g} language skills is mandatory"],
    "baltic": ["at least one of local {g} language", "at least one {g} language", "english and at least one {g} language", "a {g} language is mandatory", "a {g} language is required", "{g} language skills are required", "{g} language skills are mandatory", "{g} language skills is required", "{g} language skills is mandatory"],
}
GROUP_WELCOME = {
    "nordic": [
        "fluent in a {g} language", "a {g} language is an advantage", "a {g} language is a plus", "a {g} language is a bonus", "a {g} language is preferred", "a {g} language is beneficial", "a {g} language would be an advantage", "a {g} language would be a plus", "a {g} language would be beneficial", "a {g} language seen as an advantage",
        "knowledge of a {g} language", "{g} language skills is an advantage", "{g} language skills is a plus", "{g} language skills is preferred", "{g} language skills are an advantage", "{g} language skills are a plus", "{g} language skills are preferred", "another {g} language is an advantage", "another {g} language is a plus", "another {g} language is a bonus", "another {g} language is preferred", "another {g} language is beneficial",
        "a {g} language is a strong advantage", "proficiency in one of the {g} languages is beneficial", "knowledge of other {g} languages is considered an additional qualification", "{g} language is considered an additional qualification", "{g} languages are a plus but not a requirement", "{g} language is a plus but not a requirement", "{g} languages are not a requirement",
        "any {g}s language will be value addition", "any {g} language will be value addition", "any {g}s language is a value addition", "any {g} language is a value addition", "{g}s language will be value addition", "{g} language will be value addition",
    ],
    "baltic": [
        "a {g} language is an advantage", "a {g} language is a plus", "a {g} language is a bonus", "a {g} language is preferred", "a {g} language would be an advantage", "a {g} language would be a plus", "knowledge of a {g} language", "{g} language skills is an advantage", "{g} language skills is a plus", "{g} language skills are an advantage",
        "{g} language skills are a plus", "{g} language skills are preferred", "another {g} language is an advantage", "another {g} language is a plus", "another {g} language is a bonus", "another {g} language is preferred",
    ],
}
#: Phrases of our own that ask for a language of a group.
GROUP_REQUIRED_TOO = ["fluency in a {g} language", "fluency in any {g} language", "proficiency in a {g} language", "{g} languages are required", "{g} languages are mandatory"]
# Phrases that ask for the local language without its name.
GENERIC = [
    "native local country language", "native local language", "native country language", "native regional language", "local language required", "local language is required", "local language are required", "local language skills", "fluent in local language", "fluent in the local language",
    "local language: fluent", "local language: native", "local language: business level", "local language: proficient", "local language: good", "in addition to the local language",
]
# Nouns and adjectives of welcome, and what takes a requirement back.
GOODS = {"advantage", "plus", "asset", "bonus", "merit", "benefit"}
GOOD_ADJECTIVES = {"preferred", "preferable", "desirable", "beneficial"}
NOT_NEEDED = {"compulsory", "required", "mandatory", "essential", "necessary", "needed"}
COUNTS = {"two", "three", "four", "five", "the"}
#: Characters after and before a phrase in which something may take it back; words between a mention and its welcome.
REACH, GAP = 80, 8
#: Characters around "depending on location" in which a language may be named.
PLACE_REACH = 60

#: Where a text may speak of languages without a name; and how far around such a place, or a name, its sentences are read at least.
ANCHORS = [*(g for gs in GROUP_NAMES.values() for g in gs), "local language", *(f"{a} {b} language" for a in ("additional", "other") for b in ("eu", "european", "local", "regional")), "is required for all", "in addition to", "depending on"]
MARGIN = 200
#: Stands for the sentences between those that are read; neither a word nor a mark.
SKIPPED = "\x02"

#: Words (apostrophes inside), a language's sign, and marks; white space parts them.
TOKEN = re.compile(rf"{NAME}|[^\W_]+(?:['’][^\W_]+)*|[^\w\s]|_")


# Words behind names of languages that strokes part; each name gets the word and the one behind it.
CONTEXT_WORDS = {"speaking", "speaker", "language", "languages", "skills", "knowledge", "proficiency", "fluency", "required", "native", "communication"}
_SIGNS = {"(": " ", ")": " ", "&": "and", "–": " – ", "—": " – "}


def one_line(title: str | None, description: str | None) -> str:
    """Title and description in lower case as one line: brackets away, & and + as and, dashes apart, line breaks as sentence ends.

    Names that strokes part in front of a context word are told apart: "a/b language skills" becomes "a language skills b language
    skills". Null parts are left out.
    """
    text = " ".join(x for x in (title, description) if x is not None).lower()
    for sign, said in _SIGNS.items():
        text = text.replace(sign, said)
    if "and/or" in text:
        text = re.sub(r"\s*\band/or\b\s*", "/", text)
    words = re.sub(r"\n+", ". ", text).split()
    if "/" not in text and "+" not in text:
        return " ".join(words)
    out, at = [], 0
    for i in [i for i, w in enumerate(words) if "/" in w or w == "+"]:
        out += words[at:i]
        at, w = i + 1, words[i]
        if w == "+" and 0 < i < len(words) - 1:
            w = "and"
        if "/" in w and i + 1 < len(words):
            following = [re.match("[a-z]*", x).group() for x in words[i + 1 : i + 3]]
            said = following[: 1 + (following[0] == words[i + 1])]
            names = re.search("[a-z/]*$", w).group().split("/")
            if said[0] in CONTEXT_WORDS and len(names) > 1 and all(names[1:]):
                # a mark that stands before the first name stays; the last name has the words behind it already
                for n, name in enumerate(names[:-1]):
                    out += [w[: len(w) - len("/".join(names))] + name if n == 0 else name, *filter(None, said)]
                w = names[-1]
        out.append(w)
    return " ".join([*out, *words[at:]])


@dataclass(frozen=True)
class Forms:
    """Phrases around a language ({l}) or a group ({g}), and the words that name each language."""

    names: dict[str, list[str]]
    mentions: tuple[str, ...] = tuple(MENTIONS)
    modifiers: tuple[str, ...] = tuple(MODIFIERS)
    welcome: tuple[str, ...] = tuple(WELCOME)
    required: tuple[str, ...] = tuple(REQUIRED)
    generic: tuple[str, ...] = tuple(GENERIC)

    def phrases(self) -> dict[str, list[tuple[str, str]]]:
        """Phrase -> the kinds it is of; a phrase of several kinds counts for each."""
        out: dict[str, list[tuple[str, str]]] = {}

        def put(phrase: str, kind: str, of: str = "") -> None:
            kinds = out.setdefault(phrase.lower().replace("{l}", NAME), [])
            if (kind, of) not in kinds:
                kinds.append((kind, of))

        for m in self.mentions:
            put(m, "mention")
            for x in self.modifiers:
                put(f"{m} {x}", "welcome")
        for kind, forms in (("welcome", self.welcome), ("required", self.required), ("generic", self.generic)):
            for f in forms:
                put(f, kind)
        for kind, by_group, more in (("group required", GROUP_REQUIRED, GROUP_REQUIRED_TOO), ("group welcome", GROUP_WELCOME, [])):
            for group, forms in by_group.items():
                for f in [*forms, *more]:
                    for g in GROUP_NAMES[group]:
                        put(f.replace("{g}", g), kind, group)
        return out


@lru_cache(maxsize=4)
def automaton(phrases: tuple[str, ...]):
    """An Aho-Corasick automaton of a worker; hits are (last character, index of the phrase)."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for i, p in enumerate(phrases):
        a.add_word(p, i)
    a.make_automaton()
    return a


class Reader:
    """Reads normalised texts by some forms."""

    def __init__(self, forms: Forms):
        self.named = {w: language for language, ws in forms.names.items() for w in ws}
        self.name_words = tuple(self.named)
        phrases = forms.phrases()
        self.phrases, self.kinds = tuple(phrases), list(phrases.values())

    def read(self, text: str) -> Reading:
        spans, at = [], 0  # of names, the longest of those that overlap
        for last, i in automaton(self.name_words).iter_long(text):
            name, a = self.name_words[i], last + 1 - len(self.name_words[i])
            if a and text[a - 1].isalpha() and name[0] != name[0].upper():
                continue  # inside of a word: no name. Scripts without cases put words and particles before one without a space
            spans.append((a, last + 1, self.named[name]))
        parts = []
        for a, b, _ in spans:
            parts += [text[at:a], NAME]
            at = b
        return Reading(self, text, "".join([*parts, text[at:]]), spans)


class Reading:
    """One text: `marked` has a sign for each name; places are those of `marked` unless said otherwise."""

    def __init__(self, reader: Reader, text: str, marked: str, spans: list[tuple[int, int, str]]):
        self.reader, self.text, self.marked, self.spans = reader, text, marked, spans
        self.name_at, gone = [], 0
        for a, b, _ in spans:
            self.name_at.append(a - gone)
            gone += b - a - 1

    def language(self, at: int) -> str:
        return self.spans[bisect_right(self.name_at, at) - 1][2]

    def original(self, a: int, b: int) -> str:
        """The text of a stretch of `marked`."""

        def place(p: int) -> int:
            k = bisect_right(self.name_at, p - 1)
            return p if not k else self.spans[k - 1][1] + p - self.name_at[k - 1] - 1

        return self.text[place(a) : place(b)].strip()

    def stretches(self) -> list[tuple[int, int]]:
        """The whole sentences around names and anchors, `MARGIN` characters to either side at least.

        No rule reads on past the end of a sentence but by a few words, as no list and no run of words has a full stop in it.
        """
        text, places = self.marked, list(self.name_at)
        for a in ANCHORS:
            at = text.find(a)
            while at >= 0:
                places.append(at)
                at = text.find(a, at + 1)
        out: list[tuple[int, int]] = []
        for at in sorted(places):
            if out and at < out[-1][1] - MARGIN:
                continue
            lo = text.rfind(". ", out[-1][1] - 2 if out else 0, max(0, at - MARGIN)) + 1
            hi = text.find(". ", at + MARGIN) + 1 or len(text)
            if out and lo <= out[-1][1]:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    @cached_property
    def tokens(self) -> list[tuple[str, int, int]]:
        out: list[tuple[str, int, int]] = []
        for lo, hi in self.stretches():
            if lo > 0:
                out.append((SKIPPED, lo, lo))
            out += [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(self.marked, lo, hi)]
        if out and hi < len(self.marked):
            out.append((SKIPPED, hi + 1, hi + 1))
        return out

    @cached_property
    def token_starts(self) -> list[int]:
        return [t[1] for t in self.tokens]

    def word(self, i: int) -> str:
        return self.tokens[i][0] if 0 <= i < len(self.tokens) else ""

    def after(self, at: int) -> int:
        """The first token that begins at `at` or later."""
        return bisect_left(self.token_starts, at)

    @cached_property
    def hits(self) -> dict[str, list[tuple[int, int, str, str]]]:
        """kind -> (from, to, phrase, of) by place."""
        out: dict[str, list[tuple[int, int, str, str]]] = {}
        for last, i in automaton(self.reader.phrases).iter(self.marked):
            p = self.reader.phrases[i]
            for kind, of in self.reader.kinds[i]:
                out.setdefault(kind, []).append((last + 1 - len(p), last + 1, p, of))
        return out

    def own(self, hit: tuple[int, int, str, str]) -> str:
        """The language of a phrase around a name."""
        return self.language(hit[0] + hit[2].index(NAME))

    # -- the scanner ---------------------------------------------------------------------------------------------------------

    def is_word(self, i: int) -> bool:
        w = self.word(i)
        return bool(w) and (w == NAME or w[0].isalnum())

    def good(self, i: int, adjectives: int = 2) -> int:
        """The token after "[a] [very big] plus" at i, or -1."""
        i += self.word(i) in ("a", "an")
        for k in range(adjectives + 1):
            if self.word(i + k) in GOODS:
                return i + k + 1
            if not self.is_word(i + k):
                return -1
        return -1

    def verb(self, i: int) -> int:
        """The token after "is", "are", "would be" or "will be" at i, or i."""
        w = self.word(i)
        return i + 1 if w in ("is", "are") else i + 2 if w in ("would", "will") and self.word(i + 1) == "be" else i

    def welcomed(self, i: int, bare: bool) -> int:
        """The token after "is [seen as] a big plus", "considered an asset", "as a bonus", "is preferred" at i, or -1.

        With `bare` the verb and the article may be missing, as after a list.
        """
        starts = {i} if bare else set()
        j = i + (self.word(i) == "considered")
        starts |= {j, j + 1} if j > i and self.word(j) == "as" else {j} if j > i else set()
        for v in {self.verb(i), self.verb(j)} - {i, j}:
            if self.word(v) in GOOD_ADJECTIVES | {"advantageous"}:
                return v + 1
            starts |= {v, v + 1, v + 2} if self.is_word(v) and self.word(v + 1) == "as" else {v, v + 1} if self.is_word(v) else {v}
        if self.word(i) == "as":
            starts.add(i + 1)
        if self.word(i) == "seen" and self.word(i + 1) == "as":
            starts.add(i + 2)
        for s in sorted(starts):
            if self.word(s) in ("advantageous", "preferred") and s > i:
                return s + 1
            if bare or s > i and self.word(s) in ("a", "an"):
                end = self.good(s)
                if end > 0:
                    return end
        return -1

    def listed(self, i: int) -> tuple[int, int]:
        """For a list that goes on after token i ("X, Y or Z", "X or other Z languages"): the token after it, and after its group."""
        i += 1
        while self.word(i) == "," and self.is_word(i + 1) and self.word(i + 1) not in ("or", "and"):
            i += 2
        j = i + (self.word(i) == ",")
        if self.word(j) != "or":
            return i, -1
        if self.word(j + 1) in ("additional", "another", "other", "similar") and self.is_word(j + 2) and self.word(j + 3) in ("language", "languages"):
            return i, j + 4
        return (j + 2, -1) if self.is_word(j + 1) else (i, -1)

    def welcomes(self) -> dict[str, tuple[int, int]]:
        """language -> the first stretch that welcomes it."""
        out: dict[str, tuple[int, int]] = {}

        def put(language: str, a: int, b: int) -> None:
            if language not in out or a < out[language][0]:
                out[language] = (a, b)

        for hit in self.hits.get("welcome", ()):
            put(self.own(hit), hit[0], hit[1])
        done = 0
        for p in self.name_at:
            i = self.after(p)
            if i < done:
                continue
            end, group = self.listed(i)
            if i + 1 < end or group > 0:  # a list, which welcomes each of its names; it is read once, from its first
                last = max(self.welcomed(end, bare=True), self.welcomed(group, bare=True) if group > 0 else -1)
            else:
                last = max(self.welcomed(end, bare=False), self.good(end) if self.word(end) in ("a", "an") else -1)
            if last > 0:
                for k in range(i, end):
                    if self.word(k) == NAME:
                        put(self.language(self.tokens[k][1]), self.tokens[i][1], self.tokens[last - 1][2])
            done = end
        for hit in self.hits.get("mention", ()):
            if len(hit[2]) == 1:
                continue
            i = self.after(hit[1])
            for k in range(i, i + GAP + 1):
                if (last := self.welcomed(k, bare=False)) > 0:
                    put(self.own(hit), hit[0], self.tokens[last - 1][2])
                    break
                if not self.is_word(k) or self.word(k) in (NAME, "english"):
                    break
        return out

    def taken_back(self, hit: tuple[int, int, str, str]) -> str:
        """What the clause around a requirement makes of it: "none" (English is enough), "welcome", or nothing."""
        i = self.after(hit[1])
        other, j = False, i
        # the direct continuation
        if self.word(i) == "preferred":
            return "welcome"
        v = self.verb(i)
        if v > i and (self.word(v) in GOOD_ADJECTIVES or (self.word(v), self.word(v + 1), self.word(v + 2)) == ("nice", "to", "have") or self.word(v) == "nice" and self.word(i) == "would"):
            return "welcome"
        if v > i and self.word(v) == "of" and any(self.word(v + k) == "added" and self.word(v + k + 1) == "value" for k in (1, 2, 3)):
            return "welcome"
        direct = self.welcomed(i, bare=False) if v > i else -1
        if direct > 0:
            return "welcome"
        while j < len(self.tokens) and self.tokens[j][1] < hit[1] + REACH:
            w, nxt = self.word(j), self.word(j + 1)
            if w in (".", ";", "!", "?") and (j + 1 == len(self.tokens) or self.tokens[j + 1][1] > self.tokens[j][2]) or w == "and" and nxt == "can":
                break
            if w == "or" and (nxt == "english" or nxt == "in" and self.word(j + 2) == "english"):
                return "none"
            if not other and self._optional(j):
                return "welcome"
            other = other or w in (NAME, "english")
            j += 1
        return "welcome" if self._invited(self.after(hit[0]), hit[0]) else ""

    def _optional(self, j: int) -> bool:
        w, a, b, c = (self.word(j + k) for k in range(4))
        if w == "nice":  # with strokes or spaces, but not the head of a section
            words = [x for x in (self.word(j + k) for k in range(1, 8)) if x != "-"]
            return words[:2] == ["to", "have"] and words[2:3] != [":"] and words[3:4] != [":"]
        if w == "optional" and self.word(j - 1) == "is":
            return True
        if w == "not":
            return a in NOT_NEEDED or a == "a" and b in ("must", "requirement")
        if w == "considered":
            k = j + 1 + (a == "as")
            return self.word(k) in ("a", "an") and self.good(k) > 0
        return False

    def _invited(self, i: int, at: int) -> bool:
        """Whether "bonus points if you", "it is a plus if", "would be great if you", "nice to have" stands right before token i."""
        if i and self.tokens[i - 1][1] < at - REACH:
            return False
        words = [self.word(k) for k in range(max(0, i - 6), i)]
        if words[-1:] == ["you"]:
            words.pop()
        if words[-1:] != ["if"]:
            return words[-3:] == ["nice", "to", "have"]
        words.pop()
        if words[-3:] == ["nice", "to", "have"] or words[-1:] == ["bonus"] or words[-2:] in (["bonus", "points"], ["bonus", "point"]) or words[-1:] and words[-1] in ("plus", "advantage", "benefit"):
            return True
        return words[-3:-1] == ["would", "be"] and words[-1] in ("great", "nice", "ideal")

    def requirements(self, welcomes: dict[str, tuple[int, int]] | None = None) -> dict[str, tuple[str, str]]:
        """language -> ("required" or "welcome", matched): the first phrase that stands, else the first that its clause makes a welcome.

        A phrase inside a longer welcome is one. Phrases whose clause has English as enough say nothing.
        """
        welcomes = self.welcomes() if welcomes is None else welcomes
        out: dict[str, tuple[str, str]] = {}
        for hit in sorted(self.hits.get("required", ()), key=lambda h: (h[0], -h[1])):
            language = self.own(hit)
            if out.get(language, ("",))[0] == "required":
                continue
            if hit[2].startswith("knowledge of "):
                i = self.after(hit[1])
                w = self.word(i)
                if w and w[0].isalpha() and w not in OF_LANGUAGE:
                    continue
            inside = welcomes.get(language)
            says = "welcome" if inside and inside[0] <= hit[0] and hit[1] <= inside[1] else self.taken_back(hit)
            if says == "none" or says == "welcome" and language in out:
                continue
            out[language] = (says or "required", self.original(hit[0], hit[1]))
        return out

    def group(self, kind: str, group: str | None) -> str | None:
        """The first phrase of a kind for a group of languages."""
        found = min((h for h in self.hits.get(f"group {kind}", ()) if h[3] == group), default=None)
        if found:
            return self.original(found[0], found[1])
        if kind != "welcome" or not group:
            return None
        every = {g for gs in GROUP_NAMES.values() for g in gs}
        for i, (w, a, _) in enumerate(self.tokens):  # "X or other Nordic languages are a plus", "knowledge of Nordic or Baltic languages"
            if w in every and self.word(i + 1) in ("language", "languages"):
                k = i + 2 + (self.word(i + 2) == "skills")
                if w in GROUP_NAMES[group] and (last := self.welcomed(k, bare=False)) > 0:
                    return self.original(a, self.tokens[last - 1][2])
                other = self.word(i - 1) == "other" and self.word(i - 2) == "or" and self.is_word(i - 3)
                known = [self.word(i - 2), self.word(i - 1)] == ["knowledge", "of"] or self.word(i - 1) == "or" and [self.word(i - 4), self.word(i - 3)] == ["knowledge", "of"]
                if (other or known) and (last := self.welcomed(i + 2, bare=True)) > 0:
                    return self.original(self.tokens[i - 3][1] if other else a, self.tokens[last - 1][2])
        return None

    def generic(self) -> str | None:
        """The first phrase that asks for the local language."""
        found = min(self.hits.get("generic", ()), default=None)
        return self.original(found[0], found[1]) if found else None

    def generic_welcome(self) -> str | None:
        """"Local language ... is a plus", "additional EU languages are an asset", in one sentence."""
        for i, (w, a, b) in enumerate(self.tokens):
            local = w == "local" and self.word(i + 1) == "language"
            further = w in ("additional", "other") and self.word(i + 1) in ("eu", "european", "local", "regional") and self.word(i + 2) in ("language", "languages")
            if not (local or further):
                continue
            k = i + (2 if local else 3)
            end = self.tokens[k - 1][2] + (REACH if local else REACH // 2)
            while k < len(self.tokens) and self.word(k) != "." and self.tokens[k][1] <= end + 1:
                v = self.verb(k)
                if v > k:
                    v += self.word(v) in ("a", "an")
                    if self.word(v) in GOODS - {"merit", "benefit"} or self.word(v) in GOOD_ADJECTIVES - {"desirable"}:
                        return self.original(a, self.tokens[v][2])
                k += 1
        return None

    def your_local(self) -> tuple[str, str] | None:
        """(language, matched) of "your local language X"."""
        for p in self.name_at:
            i = self.after(p)
            if [self.word(i - 3), self.word(i - 2), self.word(i - 1)] == ["your", "local", "language"]:
                return self.language(p), self.original(self.tokens[i - 3][1], p + 1)
        return None

    def all_required(self) -> tuple[list[str], str] | None:
        """(languages, matched) of "A, B and C: ... proficiency is required for all three languages"."""
        for i, (w, _, _) in enumerate(self.tokens):
            if w != ":":
                continue
            k = i + 1
            while self.is_word(k) and self.word(k) not in ("proficiency", "fluency"):
                k += 1
            if not self.is_word(k) or [self.word(k + n) for n in range(1, 5)] != ["is", "required", "for", "all"] or self.word(k + 5) not in COUNTS or self.word(k + 6) != "languages":
                continue
            j, items = i - 1, []  # back over "A, B and C"
            while self.is_word(j) and self.word(j) != "and":
                items.append(j)
                if self.word(j - 1) == "and" and len(items) == 1:
                    j -= 2 + (self.word(j - 2) == ",")
                elif self.word(j - 1) == "," and len(items) > 1:
                    j -= 2
                else:
                    break
            names = [self.language(self.tokens[x][1]) for x in reversed(items) if self.word(x) == NAME]
            if len(items) > 1 and names:
                return list(dict.fromkeys(names)), self.original(self.tokens[items[-1]][1], self.tokens[k + 6][2])
        return None

    def in_addition(self) -> dict[str, str]:
        """language -> matched, for all but the first of "in addition to X, Y or Z" behind an "or"."""
        out: dict[str, str] = {}
        for i, (w, a, _) in enumerate(self.tokens):
            if w == "in" and self.word(i + 1) == "addition" and self.word(i + 2) == "to":
                k = i + 3
                while self.is_word(k) and self.word(k + 1) in (",", "or") and self.is_word(k + 2):
                    if self.word(k + 1) == "or" and self.word(k + 2) == NAME:
                        out.setdefault(self.language(self.tokens[k + 2][1]), self.original(a, self.tokens[k + 2][2]))
                    k += 2
        return out

    def depending(self) -> set[str]:
        """Languages that are named near "depending on [the, your] location"."""
        out: set[str] = set()
        for i, (w, a, _) in enumerate(self.tokens):
            if w == "depending" and self.word(i + 1) == "on":
                k = i + 2 + (self.word(i + 2) in ("the", "your"))
                if self.word(k) == "location":
                    lo, hi = bisect_right(self.name_at, a - PLACE_REACH - 1), bisect_right(self.name_at, self.tokens[k][2] + PLACE_REACH)
                    out |= {self.spans[n][2] for n in range(lo, hi)}
        return out
