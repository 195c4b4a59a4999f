"""Labelling functions for broken prompt and response pairs: each votes +1 (defect), -1 (no defect) or 0 on one answer."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

from tallyloom.llm.languages import FUNCTION_WORDS, SCRIPTS

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")
#: Labelling functions of each defect, in the order of the votes.
FUNCTIONS = {
    "empty": ("no_letters", "filler_word", "blank"),
    "refusal": ("inability", "declining", "other_tongues", "shape"),
    "copy": ("same_text", "little_beside_it", "word_overlap"),
    "truncated": ("ending", "open_structure", "item_shape", "last_word"),
    "language": ("function_words", "script_and_letters", "shared_words"),
}

# What people type where an answer is missing.
FILLERS = frozenset("null none nil na nan empty noanswer noresponse noreply nothing blank tbd todo missing undefined notavailable notapplicable unanswered noneprovided noanswerprovided noanswergiven answermissing".split())
# Short good-byes that may end an answer without a full stop.
CLOSERS = frozenset(("good luck", "done", "see above", "all the best", "cheers", "thanks", "thank you", "regards", "best regards", "best wishes", "hope this helps", "hope that helps", "end", "take care", "enjoy", "viel erfolg", "bonne chance", "buena suerte"))
#: Words that no sentence, item or field ends with.
OPEN_WORDS = frozenset("the a an and or but so because since although though unless whenever while whereas of to for with in on at by from into about near as that which who whose what whatever than is are was were be been has have had will would can could should may might must not no one every each some any this these those my your our their its his her people most more instead only also often usually rarely mostly quickly clearly carefully directly der die das und oder ein eine einen mit für von zu den dem des nicht nur denn dass wenn le la les un une et ou de du des que qui pour dans avec el los las y o del para con por en".split())

_INABILITY = re.compile(r"\b(?:can'?t|cannot|can not|could not|unable to|not able to|no ability to|not in a position to)\s+(?:really |currently |possibly )?(?:help|assist|fulfil|fulfill|provide|give|answer|respond|comply|offer|share|comment|do that|discuss|support|complete|process|write)\b|\bunable to provide\b|\bno ability to assist\b|\bnot able to give advice\b")
_DECLINE = re.compile(r"\b(?:must|have to|will|would|i) (?:respectfully |politely )?decline\b|\brather not\b|\bdo(?:n'?t| not) feel comfortable\b|\bnot comfortable\b|\b(?:beyond|outside) what i\b|\bnot (?:permitted|allowed) to\b|\bi'?m permitted to\b|\bguidelines (?:prevent|do not|don'?t|forbid)\b|\bnot be appropriate for me\b|\bwon'?t (?:be )?(?:answer|help|discuss|write|comment)|\bnot something i (?:discuss|can|do|may)\b|\bfalls? outside what i\b|\bi refuse\b|\bagainst my (?:guidelines|policy)\b|\bas an? (?:ai|language model)\b[^.!?]*\bnot\b")
_OTHER = re.compile(r"\b(?:darf|kann|möchte|werde)\b[^.!?]{0,40}\bnicht\b[^.!?]{0,25}\b(?:helfen|antworten|beantworten|weiterhelfen|sagen|schreiben)\b|\btut mir leid\b|\bnichts bekommen\b|\bimpossible de (?:répondre|vous|aider)|\bne (?:peux|puis|suis)\b[^.!?]{0,30}\b(?:pas|aider|répondre|autorisé)\b|\bje refuse\b|\bdésolée?\b|\blo siento\b|\bno puedo (?:ayudar|responder|contestar)|\bno me está permitido\b|\bno estoy autorizad|\bme niego\b|抱歉|对不起|无法(?:回答|帮助|提供)|不能(?:回答|帮助|提供)")
_NOT_REFUSAL = re.compile(r"\bbut here(?:'s| is)\b|\bof course, but\b|\bcan'?t praise\b|\bshould put it right\b|\bhowever, here\b|\bthat said, here\b")
_OPENING = re.compile(r"^\W*(?:i'?m sorry|sorry|apologies|unfortunately|i regret|no, )\b")
_INTO = re.compile(r"\b(?:into|in|auf|en|ins|al|nach)\s+(english|german|french|spanish|chinese|russian|japanese|korean|englisch|deutsch|deutsche|französisch|französische|spanisch|spanische|anglais|allemand|français|espagnol|inglés|alemán|francés|español)\b")
# Names of the languages.
_NAMES = {"english": "en", "englisch": "en", "anglais": "en", "inglés": "en", "german": "de", "deutsch": "de", "deutsche": "de", "allemand": "de", "alemán": "de", "french": "fr", "französisch": "fr", "französische": "fr", "français": "fr", "francés": "fr", "spanish": "es", "spanisch": "es", "spanische": "es", "espagnol": "es", "español": "es", "chinese": "zh", "russian": "ru", "japanese": "ja", "korean": "ko"}
_TRANSLATE = re.compile(r"\b(?:translate|translation|übersetze?|übersetzen|tradui[st]|traduire|traduce|traducir)\b")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+(.*)$")
_FIELD = re.compile(r"^\W*[^\W_][\w -]{0,40}?\s*[=:](.*)$", re.S)
_FENCE = re.compile(r"```.*?```", re.S)
_LEAD = frozenset("question instruction prompt task q you asked your request the was is as here repeat repeating i quote said wrote user human asks".split())
_OF = {k: frozenset(v.split()) for k, v in FUNCTION_WORDS.items()}
_LETTERS = {"de": "äöüß", "fr": "çèêàùâîôûœ", "es": "ñ¿¡íóáú"}
_CF = {c: None for c in range(0x3000) if unicodedata.category(chr(c)) == "Cf"} | {0xFEFF: None}


_NOT_WORD = re.compile(r"[\W_]+")
_ALNUM = re.compile(r"[^\W_]")
_SENTENCES = re.compile(r"(?<=[.!?。])\s+")
#: Every function word with the languages it belongs to.
_LANGS = tuple(_OF)
_WHOSE = {w: tuple(i for i, k in enumerate(_LANGS) if w in _OF[k]) for own in _OF.values() for w in own}
#: Without one of its strings a refusal pattern cannot match.
_HINTS = (
    (_INABILITY, ("can't", "cant", "cannot", "can not", "could not", "unable to", "able to", "ability to", "in a position to")),
    (_DECLINE, ("decline", "rather not", "comfortable", "beyond what", "outside what", "permitted", "allowed to", "guidelines", "appropriate for me", "won't", "wont", "not something i", "i refuse", "against my", "language model", "as an ai", "as a ai")),
    (_OTHER, ("nicht", "tut mir leid", "impossible de", "ne peux", "ne puis", "ne suis", "je refuse", "désolé", "siento", "no puedo", "no me", "no estoy", "niego", "抱歉", "对不起", "无法", "不能")),
)


def _declines(t: str) -> tuple[bool, bool, bool]:
    """Which refusal patterns a text in lower case holds."""
    return tuple(any(h in t for h in hints) and bool(p.search(t)) for p, hints in _HINTS)


def squash(t: str) -> str:
    return _NOT_WORD.sub("", t.lower())


def plain(t: str) -> str:
    """Without invisible characters and with straight apostrophes."""
    return t if t.isascii() else t.translate(_CF).replace("’", "'").replace("‘", "'")


def language(text: str, words: list[str] | None = None) -> tuple[str | None, int]:
    """(language, weight of the evidence) by function words or script; None where nothing tells."""
    if not text.isascii():
        letters = [c for c in text if c.isalpha()]
        wide = [c for c in letters if c > "\u036f"]
        if wide and len(wide) > 0.3 * len(letters):
            n = {k: sum(a <= c <= z for c in wide) for k, (a, z) in SCRIPTS.items()}
            best = max(n, key=n.get)
            if n[best] > 0.3 * len(letters):
                return ("ja" if n["ja"] > 0.1 * n[best] else best), len(letters)
    words = _WORD.findall(text.lower()) if words is None else words
    hits = [0] * len(_LANGS)
    for w in words:
        for i in _WHOSE.get(w, ()):
            hits[i] += 1
    order = sorted(hits, reverse=True)
    if order[0] >= 2 and order[0] >= 1.5 * order[1] and order[0] >= 0.12 * len(words):
        return _LANGS[hits.index(order[0])], order[0] - order[1]
    return None, 0


@lru_cache(maxsize=1 << 16)
def asked(instruction: str) -> tuple[str, str, Counter, str | None]:
    """What every answer is held against: the instruction's letters, its text, its words and the expected language."""
    low = plain(instruction).lower()
    return squash(low), low.strip(), Counter(_WORD.findall(low)), expected(low)


def expected(instruction: str) -> str | None:
    """The language an answer should have: the one asked for, else that of the instruction."""
    low = instruction.lower()
    if _TRANSLATE.search(low):
        if m := _INTO.search(low.split(":", 1)[0]):
            return _NAMES[m[1]]
    return language(instruction)[0]


def _tail(text: str) -> tuple[int, str, list[str], bool]:
    """How the text ends: (vote, its last word where only the corpus can tell, words that end earlier items, is a list)."""
    t = text.rstrip(" \t\r\n\v\f\u00a0*_>#")
    if t[-1:] in ".!?" and "\n" not in t and ";" not in t and t[-3:] != "...":
        return -1, "", [], False
    lines = [x for x in t.split("\n") if x.strip()]
    marks = lines[-1].split(" * ") if lines else []
    items = [m[1] for x in lines if (m := _ITEM.match(x))]
    parts = [x for x in re.split(r"\s*;\s*", t) if x] if t.count(";") and "=" in t else []
    if len(parts) >= 2 and all(_FIELD.match(x) for x in parts[:-1]):
        fields = parts
    elif len(lines) >= 2 and all(_FIELD.match(x) for x in lines[:-1]) and not items:
        fields = lines
    else:
        fields = []
    ends = lambda xs: [w[-1].lower() for x in xs if (w := _WORD.findall(x))]
    if fields and not re.match(r"^\W*\{", t):
        last = fields[-1]
        m = _FIELD.match(last)
        if not m or not m[1].strip(" \t\"'"):
            return 1, "", ends(fields[:-1]), True
        w = _WORD.findall(m[1])
        if w and w[-1].lower() in OPEN_WORDS:
            return 1, "", ends(fields[:-1]), True
        # A value of one word may be a name that the corpus holds only once.
        return 0, (w[-1].lower() if len(w) > 1 and m[1].rstrip()[-1:].isalpha() else ""), ends(fields[:-1]), True
    core = t.rstrip(" \t\r\n\"'”’»)]}*_")
    end = core[-1:]
    if t.endswith("```") or (t.endswith("}") and "{" in t):
        return -1, "", [], False
    last_item = _ITEM.match(lines[-1])[1] if lines and _ITEM.match(lines[-1]) else (marks[-1] if len(marks) > 2 else None)
    if end in ".!?。！？" and end:
        return -1, "", ends(items), bool(items)
    if end == "…" or t.endswith("..."):
        return 1, "", ends(items), bool(items)
    after = re.split(r"[.!?。]\s+", t)[-1]
    if squash(after) and " ".join(_WORD.findall(after.lower())) in CLOSERS or not squash(after):
        return -1, "", [], False
    if not core or not (core[-1].isalnum()):
        if t[-1:] in "—–-" and len(re.findall(r"\s[—–]\s", t)) >= 1 and not re.search(r"[.!?]\s", t):
            return -1, "", [], False  # dashes in place of full stops
        return (1 if t[-1:] in ",;:—–-(['\"/&=" else -1), "", [], False
    words = _WORD.findall(t)
    if words and words[-1].lower() in OPEN_WORDS and t.endswith(words[-1]):
        return 1, "", ends(items), bool(last_item)
    if last_item is not None:
        return 0, words[-1].lower() if words else "", ends(items[:-1] or marks[:-1]), True
    # Earlier sentences ended properly and this one does not; scripts without spaces have none after their full stop.
    return (1 if len(words) > 6 and re.search(r"[.!?]\s", t) or "。" in t else 0), (words[-1].lower() if words and t[-1].isalpha() else ""), [], False


@lru_cache(maxsize=1 << 15)
def _short(instruction: str | None, answer: str | None) -> tuple[dict[str, list[int]], str, list[str]]:
    return _votes(instruction, answer)


def votes(instruction: str | None, answer: str | None) -> tuple[dict[str, list[int]], str, list[str]]:
    """Votes for each defect; the last word whose standing the corpus must tell ("" for none); words that end earlier items.

    Short answers to one instruction repeat, so those are remembered; the result is not to be changed."""
    return _short(instruction, answer) if answer is None or len(answer) < 40 else _votes(instruction, answer)


def _votes(instruction: str | None, answer: str | None) -> tuple[dict[str, list[int]], str, list[str]]:
    text = plain(answer or "")
    low = text.lower()
    sqi, ins, ins_words, want = asked(instruction or "")
    # Letters and digits alone matter only for answers short enough to be empty or a copy.
    words = _WORD.findall(low)
    alike = 0.85 * max(len(words), ins_words.total()) <= min(len(words), ins_words.total())  # else no overlap makes a copy
    brief = len(low) <= 2 * len(ins) + 80 or alike or len(ins) >= 12 and len(low) - low.count(ins) * len(ins) <= 80
    sq = _NOT_WORD.sub("", low) if brief or not _ALNUM.search(low) else low
    v = {d: [-1] * len(FUNCTIONS[d]) for d in DEFECTS}
    filler = sq in FILLERS
    v["empty"] = [-1 if sq else 1, 1 if filler or not sq else -1, -1 if sq and not filler else 0 if text.strip() else 1]
    if not sq or filler:
        return v, "", []
    # refusal: looked for in the whole answer; in a long one only its first two sentences, where an answer declines or
    # begins, tell for it, and what is said further on tells neither way
    long_ = len(words) > 40
    a, b, c = _declines(low)
    hit = a or b or c
    begins = not hit and len(words) < 25 and _OPENING.match(low) and len(re.split(r"[.!?]\s", low)) < 2
    if hit or begins:
        if long_:
            a, b, c = _declines(" ".join(_SENTENCES.split(low.strip(), maxsplit=2)[:2]))
        no = bool(_NOT_REFUSAL.search(low))
        vote = lambda own: 1 if own and not no else -1 if no else 0 if hit else -1
        v["refusal"] = [vote(a), vote(b), vote(c), -1 if long_ or no else 1]
    if len(sqi) >= 12 and (alike or brief and (sqi in sq or sq in sqi)):  # nothing else can be a copy
        inside = sqi in sq
        rest = len(sq) - max(1, sq.count(sqi)) * len(sqi)  # beside the instruction, however often it is given back
        beside = [w for w in _WORD.findall(low.replace(ins, " ")) if w not in _LEAD] if inside else words
        most = sum((ins_words & Counter(words)).values()) / max(1, sum(ins_words.values()), len(words))
        v["copy"] = [
            1 if inside and not rest else 0 if inside and rest <= 25 else -1,
            1 if inside and (rest <= 25 or len(beside) <= 2 and rest < 40) or sq in sqi and len(sq) >= 0.7 * len(sqi) else -1,
            1 if most >= 0.85 or inside and rest <= 25 else -1,
        ]
    # truncated
    # Scripts without gaps hold a word in two characters.
    if len(words) <= 3 and (low.isascii() or sum("\u3040" <= c <= "\ud7ff" for c in low) < 8) and "\n" not in text and "{" not in text and "```" not in text:
        v["truncated"][3] = 0  # a one-word answer
        v["language"] = [0, 0, 0]
        return v, "", []
    tail, word, ends, listed = _tail(text)
    fences = text.count("```")
    brace = text.lstrip("\"'*_>#.- \t\r\n“").startswith("{")
    closed = brace and re.search(r"\}[^\w{]*$", text) is not None
    outside = _FENCE.sub(" ", text) if fences else text
    if fences % 2 or brace and not closed or tail >= 0 and outside.count("(") > outside.count(")"):
        opened = 1
    else:
        opened = -1 if fences or closed or tail < 0 else 0
    if brace or fences:
        word, ends = "", []
        v["truncated"] = [0, opened, 0, 0]  # one sign, one vote
    else:
        shape = -1 if tail < 0 else 0
        if listed and tail >= 0:
            lines = [x for x in text.split("\n") if x.strip()]
            items = [len(_WORD.findall(m[1])) for x in lines if (m := _ITEM.match(x))]
            if len(items) >= 2 and _ITEM.match(lines[-1]):
                shape = 1 if items[-1] < min(items[:-1]) - (min(items[:-1]) > 4) else -1 if items[-1] >= max(items[:-1]) else 0
        v["truncated"] = [1 if opened == 1 else tail, opened, shape, 0]
    # language
    v["language"] = [0, 0, 0]
    if want:
        got, weight = language(outside, _WORD.findall(outside.lower()) if fences else words)
        if got and not brace:
            v["language"][0] = 1 if want != got else -1
            v["language"][2] = (1 if weight >= 3 else 0) if want != got else -1
        if low.isascii():
            v["language"][1] = (1 if got else 0) if want in SCRIPTS else -1 if got == want else 0
        else:
            own = {k: sum(map(low.count, s)) for k, s in _LETTERS.items()}
            if got in SCRIPTS:
                v["language"][1] = 1 if want != got else -1
            elif want in SCRIPTS:
                v["language"][1] = 1 if got else 0
            elif got and max(own.values()):
                v["language"][1] = (1 if got != want else -1) if own.get(got, 0) == max(own.values()) else 0
            elif got == want:
                v["language"][1] = -1
    return v, word, ends
