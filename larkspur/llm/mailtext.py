"""The lines of a mail that its sender wrote for it: without quoted history, signature and notices."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.hashing import line_print, mixed, paired, signed
from larkspur.session import cut

#: Words a passage must share with an earlier mail of the thread to count as inherited.
INHERITED_WORDS = 15
#: Words of the runs by which mails with a common passage meet; one is sampled from every passage of INHERITED_WORDS.
SAMPLED_WORDS = 6
#: A line is a mail's own beside an earlier one that holds less than this part of its words, in runs of so many; of a copy, a line of so few words may be replaced.
HELD_SHARE, HELD_WORDS, REPLACED_WORDS = 0.25, 3, 4
#: In so many texts that are no copies of each other a lonely marked line recurs that is no quotation, and in so large a part of those that hold it.
RECURRING_MARKED, LONELY_SHARE = 5, 0.5
#: In so many of a sender's mails that are no copies of each other an ending recurs that is no message, and in so large a part of them.
RECURRING_ENDING, ENDING_SHARE = 3, 0.1
#: Characters of the mails of a thread that one automaton takes; a larger thread is dealt to parts.
PART_CHARS = 1_000_000
#: From so many words on a text has edited copies; those agree in the least of one of so many orders of their word triples.
COPIED_WORDS, COPY_ORDERS = 20, 8

# What mail programs and lists put around a message, in the languages the mailboxes hold.
TAGS = re.compile(r"</?(?:div|p|br|span|b|i|u|em|strong|font|html|body|head|a|pre|blockquote|table|tr|td|ul|ol|li|hr)\b[^<>]*>", re.I)
MARK = re.compile(r"^\s*(?:[A-Za-z]{0,3}>|[|:](?=\s|$|>))")
INTRO_END = re.compile(r"(?:\bwrote|\bwrites|\byou said|\ba écrit|\bescribió|\bschreibt|\bscrive|\bha scritto)\s*:\s*$", re.I)
INTRO_SCHRIEB = re.compile(r"^\s*am\b.{0,80}\d.{0,80}\bschrieb\b.{0,80}:\s*$", re.I)
INTRO_DATE = re.compile(r"^\s*(?:on|am|le|el|il)\s+\S+\s+\d{1,2}\s+\S+\s+\d{4}.*$", re.I)
DIVIDER = re.compile(
    r"^\s*(?:-{2,}\s*(?:original|forwarded|weitergeleitete|message|ursprüngliche|mensaje|original-nachricht)\b.{0,80}-{2,}|begin forwarded message\s*:|"
    r"\*{3,}\s*reply to\b.{0,80}\*{3,})\s*$", re.I,
)
HEADER = re.compile(r"^\s*(?:from|von|de|sent|date|gesendet|datum|envoyé|enviado|fecha|to|an|à|para|cc|subject|betreff|objet|asunto)\s*:\s?", re.I)
FIRST_HEADER = re.compile(r"^\s*(?:from|von|de)\s*:\s?", re.I)
RULE = re.compile(r"^\s*(?:--?|[-_*=~#]{4,}|(?:=-){2,}=?)\s*$")
CLOSING = re.compile(
    r"^\s*(?:(?:kind|best|warm|with best|with kind)?\s*regards|best|best wishes|cheers|thanks|thank you|many thanks|thx|yours|yours sincerely|yours truly|yours faithfully|sincerely|"
    r"mit freundlichen gr\S{1,8}n|viele grüße|liebe grüße|mfg|saludos|un saludo|atentamente|cordialement|bien à vous|amitiés)\s*[,.!]?\s*$", re.I,
)
DEVICE = re.compile(r"^\s*(?:--\s*)?(?:sent (?:from|with|via)\b|gesendet (?:von|mit)\b|envoyé (?:de|depuis)\b|enviado (?:desde|con)\b)", re.I)
NOTICE = re.compile(
    r"\bunsubscribe\b.{0,200}(?:http|write|@|list)|^\s*unsubscribe\s*:|\bremove me\s*:|removed from (?:our|this)\b.{0,200}\b(?:mailings?|list)\b|mailing list\b.{0,200}@|\bgroups links\s*:|posting guide\s*:|you (?:receive|are receiving) this\b|"
    r"confidentiality notice|confidential and\b.{0,200}\bmeant|this message and its attachments|not the intended recipient|views expressed (?:above|in this)|nachricht ist vertraulich|"
    r"\bce message est confidentiel|este mensaje es confidencial", re.I,
)
NOTICE_WORDS = ("unsubscribe", "remove me", "removed from", "mailing list", "groups links", "posting guide", "receive this", "receiving this", "confidential", "confidentiel", "attachments", "intended recipient", "views expressed", "vertraulich", "este mensaje")
CONTACT = re.compile(r"^\s*(?:tel\.?|phone|fax|mobile?)\b.*\d|^\s*(?:https?://|www\.)\S+\s*$|^\s*\S{1,100}@\S{1,100}\.\S{1,100}\s*$|^\s*(?:office|dept\.?|department) of \S+(?: \S+)?\s*$", re.I)
NAME = re.compile(r"^\s*[^\W\d_]+(?:[ -][^\W\d_]+){0,2}\s*$")

#: Characters with which a line begins that is a rule, a divider or a header, and words with which a dated introduction begins.
RULED, HEADED, DATED = frozenset("-_*=~#bB"), frozenset("fFvVdD"), ("on ", "am ", "le ", "el ", "il ")


def bare_lines(body: str) -> list[str]:
    """The lines of a body (ends at line feeds) without mark-up of their own, blanks collapsed; what a quotation element holds gets a quote mark."""
    if "<" not in body:
        if "&" in body:
            body = unescaped(body)
        return [" ".join(x.split()) for x in body.split("\n")]
    out = []
    depth = 0
    for line in body.split("\n"):
        if "<" in line:
            low = line.lower()
            inside = depth > 0 or "<blockquote" in low
            depth = max(0, depth + low.count("<blockquote") - low.count("</blockquote"))
            line = TAGS.sub("", line)
            if inside and line.strip():
                line = "> " + line
        elif depth and line.strip():
            line = "> " + line
        if "&" in line:
            line = unescaped(line)
        out.append(" ".join(line.split()))
    return out


def unescaped(text: str) -> str:
    return text.replace("&gt;", ">").replace("&lt;", "<").replace("&nbsp;", " ").replace("&amp;", "&")


def is_marked(line: str) -> bool:
    return (">" in line or line[:1] in ("|", ":")) and MARK.match(line) is not None


def unmarked(line: str) -> str:
    return MARK.sub("", line) if ">" in line or line[:1] in ("|", ":") else line


def _next_text(lines: list[str], i: int) -> int:
    while i < len(lines) and not lines[i].strip():
        i += 1
    return i


def _introduces(line: str) -> bool:
    """Whether a line says that someone wrote what follows."""
    if line[-1:] != ":" or not (INTRO_END.search(line) or INTRO_SCHRIEB.match(line)):
        return False
    if re.match(r"^\s*(?:he|she|they|you|we|i|on \w+ (?:he|she|they|i|we|you))\s+(?:wrote|writes)", line, re.I):
        return False
    return bool(re.search(r"\d|@|<", line) or line[:1].isalpha() and NAME.match(re.sub(r"\s*(?:wrote|writes|schreibt)\s*:\s*$", "", line, flags=re.I)))


def _dated(line: str) -> bool:
    return line[:3].lower() in DATED and INTRO_DATE.match(line) is not None


def quoted_lines(lines: list[str]) -> tuple[list[bool], int, list[int]]:
    """Which lines are quoted or introduce a quotation; from which line on all is forwarded; the lonely marked lines.

    A run of marked lines is a quotation, with the introduction above it. A single marked line without introduction is lonely and counts as one too, until
    it turns out that the same words recur, mostly alone, in texts and threads all over the collection: then the mark is part of what was written.
    So may be the edges of a longer run, which are told apart in the same way.
    """
    n = len(lines)
    marked = [is_marked(x) for x in lines]
    quoted = list(marked)
    lonely: list[int] = []
    introduced = [False] * n
    for i, line in enumerate(lines):
        if not line or marked[i]:
            continue
        if _introduces(line):
            following = _next_text(lines, i + 1)
            if following < n and marked[following]:
                quoted[i] = introduced[following] = True
                before = i - 1
                if before >= 0 and not marked[before] and _dated(lines[before]) and not _dated(line):
                    quoted[before] = True
            elif following < n and _dated(line):
                quoted[i] = True
        elif _dated(line):
            following = _next_text(lines, i + 1)
            if following < n and INTRO_END.search(lines[following]):
                quoted[i] = True
    i = 0
    while i < n:
        if not marked[i]:
            i += 1
            continue
        j = i
        while j < n and marked[j]:
            j += 1
        if j - i > 1:
            lonely += [k for k in (i, j - 1) if not introduced[k] and len(unmarked(lines[k]).split()) >= 3]
        elif not introduced[i]:
            lonely.append(i)
        i = j
    forwarded = n
    for i, line in enumerate(lines):
        head = line[:1]
        if marked[i] or head not in RULED and head not in HEADED:
            continue
        at = i
        divides = head in RULED and DIVIDER.match(line) is not None
        if divides or (head in RULED and i + 1 < n and RULE.match(line) and FIRST_HEADER.match(lines[i + 1])):
            at = _next_text(lines, i + 1)
        if divides or at < n and FIRST_HEADER.match(lines[at]) and sum(1 for x in lines[at : at + 5] if HEADER.match(x)) >= 3:
            forwarded = i
            break
    return quoted, forwarded, lonely


def is_notice(line: str) -> bool:
    low = line.lower()
    return any(w in low for w in NOTICE_WORDS) and NOTICE.search(line) is not None


def _signs(line: str) -> bool:
    """Whether a line is a name, a contact, a rule, a device's or a notice."""
    return any(p.match(line) for p in (NAME, CONTACT, DEVICE, RULE)) or is_notice(line)


def ending_from(lines: list[str], quoted: list[bool], stop: int) -> int:
    """The line where the sender's closing, signature or the notices begin, ``stop`` if there is none."""
    text = [i for i in range(stop) if lines[i] and not quoted[i]]
    for place, i in enumerate(text):
        line = lines[i]
        rest = text[place + 1 :]
        if DEVICE.match(line) or place and is_notice(line):
            return i
        if CLOSING.match(line) and (place or rest) and (not rest or any(p.match(lines[rest[0]]) for p in (NAME, RULE, DEVICE, CONTACT))):
            return i
        if line[0] in RULED and RULE.match(line) and (not rest or _signs(lines[rest[0]]) and (place or all(_signs(lines[k]) for k in rest))):
            return i
        if place and CONTACT.match(line) and all(_signs(lines[k]) for k in rest):
            return text[place - 1] if place > 1 and NAME.match(lines[text[place - 1]]) else i
    return stop


def _before_names(lines: list[str], text: list[int], stop: int) -> int:
    """Drops bare names, set off at the end, from ``text``; the line where the rest ends."""
    while len(text) > 1:
        last = text[-1]
        if not (NAME.match(lines[last]) and not lines[last - 1].strip() and all(w[0].isupper() or lines[last].islower() for w in re.split(r"[ -]", lines[last].strip()))):
            break
        stop = text.pop()
    return stop


@dataclass
class Mail:
    """A mail's bare lines, which of them are marked as quoted, and where what is forwarded begins."""

    lines: list[str]
    quoted: list[bool]
    forwarded: int
    _words: tuple[list[str], list[int]] | None = None

    @classmethod
    def of(cls, body: str) -> Mail:
        lines = bare_lines(body)
        return cls(lines, *quoted_lines(lines)[:2])

    @classmethod
    def read(cls, text: str, quoted: list[int], forwarded: int) -> Mail:
        """A mail from its bare lines, the numbers (from 0) of the quoted ones, and the line where what is forwarded begins."""
        lines = text.split("\n")
        flags = [False] * len(lines)
        for i in quoted:
            flags[i] = True
        return cls(lines, flags, forwarded)

    @property
    def words(self) -> list[str]:
        """The words in order, quote marks and wrapping aside."""
        return self._placed()[0]

    @property
    def line_of(self) -> list[int]:
        return self._placed()[1]

    def _placed(self) -> tuple[list[str], list[int]]:
        if self._words is None:
            self._words = words_of(self.lines, range(len(self.lines)))
        return self._words

    def written(self) -> list[int]:
        """The non-blank lines (from 0) that no mark, introduction or header tells to be quoted."""
        return [i for i in range(self.forwarded) if self.lines[i] and not self.quoted[i]]

    def own(self, inherited: Iterable[int] = (), ending: int = 0) -> list[int]:
        """Numbers (from 1) of the non-blank lines the sender newly wrote; the last ``ending`` of them are one the sender uses again and again."""
        quoted = list(self.quoted)
        for i in inherited:
            quoted[i] = True
        stop = ending_from(self.lines, quoted, self.forwarded)
        text = [i for i in range(stop) if self.lines[i] and not quoted[i]]
        stop = _before_names(self.lines, text, stop)
        for _ in range(min(ending, len(text) - 1)):
            stop = text.pop()
        _before_names(self.lines, text, stop)
        return [i + 1 for i in text]


def endings_of(mail: Mail, inherited: Iterable[int] = ()) -> list[tuple[int, int, list[int]]]:
    """For no line, the last line, the last two and so on of those a sender wrote, but the first: their number, their print, and the copy prints of the words before."""
    text = [i - 1 for i in mail.own(inherited)]
    words, at = words_of(mail.lines, text)
    before = copy_prints_of_prefixes(words, np.searchsorted(at, text, side="right").tolist()) if words else [[0] * COPY_ORDERS] * len(text)
    out = []
    suffix = 0
    for k in range(len(text), 0, -1):
        out.append((len(text) - k, suffix, before[k - 1]))
        suffix = xxhash.xxh64_intdigest(f"{suffix} {line_print(mail.lines[text[k - 1]])}") >> 1
    return out


class SuffixAutomaton:
    """All runs of words of several texts, as the states of their generalised suffix automaton."""

    def __init__(self) -> None:
        self.step: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add(self, words: list[str]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _new(self, length: int, link: int, step: dict[str, int]) -> int:
        self.step.append(step)
        self.link.append(link)
        self.length.append(length)
        return len(self.step) - 1

    def _split(self, p: int, w: str, q: int) -> int:
        copy = self._new(self.length[p] + 1, self.link[q], dict(self.step[q]))
        while p >= 0 and self.step[p].get(w) == q:
            self.step[p][w] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, w: str) -> int:
        q = self.step[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.step[p]:
            self.step[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.step[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def inherited(self, words: list[str], least: int) -> list[bool]:
        """Which words stand in a run of at least ``least`` that one of the texts holds."""
        state = length = 0
        marks = [0] * (len(words) + 1)
        for i, w in enumerate(words):
            while state and w not in self.step[state]:
                state = self.link[state]
                length = self.length[state]
            if w in self.step[state]:
                state = self.step[state][w]
                length += 1
            if length >= least:
                marks[i - length + 1] += 1
                marks[i + 1] -= 1
        out, depth = [], 0
        for m in marks[:-1]:
            depth += m
            out.append(depth > 0)
        return out


_WORD = re.compile(r"[^\W_]+")


def words_of(lines: list[str], among: Iterable[int]) -> tuple[list[str], list[int]]:
    """The words of the lines ``among`` in order, quote marks aside, and the line of each."""
    words, at = [], []
    for i in among:
        found = _WORD.findall(unmarked(lines[i]).lower())
        words += found
        at += [i] * len(found)
    return words, at


def word_hashes(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of several texts, and the number of its text."""
    known: dict[str, int] = {}
    for w in set().union(*texts):
        known[w] = xxhash.xxh64_intdigest(w)
    size = [len(t) for t in texts]
    return np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), np.uint64, sum(size)), np.repeat(np.arange(len(texts)), size)


def run_hashes(one: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` words."""
    out = one[: max(len(one) - size + 1, 0)].copy()
    for k in range(1, size):
        out = paired(out, one[k : k + len(out)])
    return out


def sampled_runs(texts: list[list[str]], size: int = SAMPLED_WORDS, passage: int = INHERITED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, of which every passage of ``passage`` words has one, the least of its window; and the number of the text of each."""
    one, text = word_hashes(texts)
    if len(one) < passage:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    run = run_hashes(one, size)
    window = np.lib.stride_tricks.sliding_window_view(run, passage - size + 1)
    start = np.flatnonzero(text[: len(window)] == text[passage - 1 :])
    at = np.unique(window[start].argmin(axis=1) + start)
    order = np.lexsort((run[at], text[at]))
    run, text = run[at][order], text[at][order]
    new = np.ones(len(run), dtype=bool)
    new[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    return run[new], text[new]


def passages_around(texts: list[list[str]], runs: list[list[int]], size: int = SAMPLED_WORDS, passage: int = INHERITED_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all passages of ``passage`` words that hold one of their text's ``runs`` whole, and the number of the text of each."""
    one, text = word_hashes(texts)
    if len(one) < passage:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    wanted = np.fromiter(chain.from_iterable(runs), np.int64, sum(map(len, runs))).view(np.uint64)
    whose = np.repeat(np.arange(len(runs)), [len(r) for r in runs]).astype(np.uint64)
    run = run_hashes(one, size)
    held = np.isin(paired(run, text[: len(run)].astype(np.uint64)), paired(wanted, whose))
    before = np.concatenate([[0], np.cumsum(held)])
    start = np.flatnonzero(text[: len(one) - passage + 1] == text[passage - 1 :])
    start = start[before[start + passage - size + 1] > before[start]]
    found, text = run_hashes(one, passage)[start], text[start]
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return found[new], text[new]


def copy_prints_of_prefixes(words: list[str], sizes: list[int]) -> list[list[int]]:
    """COPY_ORDERS prints of the first words of a text, for several numbers of words; edited copies share some prints, other texts seldom share one."""
    one, _ = word_hashes([words])
    run = run_hashes(one, 3)
    orders = np.array([[k * 0x9E3779B97F4A7C15 % 2**64] for k in range(COPY_ORDERS)], dtype=np.uint64)
    least = np.minimum.accumulate(mixed(run ^ orders) >> np.uint64(1), axis=1) if len(run) else None
    out = []
    for n in sizes:
        if n < COPIED_WORDS:
            out.append([xxhash.xxh64_intdigest(" ".join(words[:n])) >> 1] * COPY_ORDERS)
        else:
            out.append(least[:, n - 3].tolist())
    return out


def copy_prints(words: list[str]) -> list[int]:
    """The same of a whole text."""
    return copy_prints_of_prefixes(words, [len(words)])[0]


_PARSED = "id bigint, text string, quoted array<int>, forwarded int, runs array<bigint>, lonely array<struct<line:int,print:bigint,alone:boolean>>, copies array<bigint>"
_LONELY = pa.list_(pa.struct([("line", pa.int32()), ("print", pa.int64()), ("alone", pa.bool_())]))


def _parse_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every mail is read once: what later steps need of it are columns."""
    for whole in batches:
        for start in range(0, len(whole), 1000):
            batch = whole.slice(start, 1000)
            threaded = batch.column("thread").is_valid().to_pylist()
            texts, quotes, ends, lonelies, copies, words = [], [], [], [], [], []
            for body, t in zip(batch.column("body").to_pylist(), threaded, strict=True):
                lines = bare_lines(body)
                quoted, forwarded, lonely = quoted_lines(lines)
                texts.append("\n".join(lines))
                quotes.append([i for i, q in enumerate(quoted) if q])
                ends.append(forwarded)
                found = _WORD.findall("\n".join(map(unmarked, lines)).lower()) if t or lonely else []
                words.append(found if t else [])
                alone = {i: not any(0 <= k < len(lines) and is_marked(lines[k]) for k in (i - 1, i + 1)) for i in lonely}
                lonelies.append([{"line": i, "print": line_print(unmarked(lines[i])), "alone": alone[i]} for i in lonely])
                copies.append(copy_prints(found) if lonely else None)
            run, text = sampled_runs(words)
            bounds = np.searchsorted(text, np.arange(len(texts) + 1))
            yield pa.record_batch({
                "id": batch.column("id"), "text": pa.array(texts, pa.string()), "quoted": pa.array(quotes, pa.list_(pa.int32())), "forwarded": pa.array(ends, pa.int32()),
                "runs": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(run), pa.int64())), "lonely": pa.array(lonelies, _LONELY), "copies": pa.array(copies, pa.list_(pa.int64())), **{c: batch.column(c) for c in ("received", "sender", "thread")},
            })


def _passage_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, len(whole), 1000):
            batch = whole.slice(start, 1000)
            texts = [_WORD.findall("\n".join(map(unmarked, t.split("\n"))).lower()) for t in batch.column("text").to_pylist()]
            found, text = passages_around(texts, batch.column("runs").to_pylist())
            yield pa.record_batch({"id": batch.column("id").take(pa.array(text)), "passage": pa.array(signed(found), pa.int64())})


def _triples(words: list[str]) -> set[tuple[str, ...]]:
    return set(zip(*(words[k:] for k in range(HELD_WORDS)), strict=False))


def _unheld(lines: list[str], among: list[int], triples: set[tuple[str, ...]]) -> list[int]:
    """Those of the lines ``among`` of whose words less than HELD_SHARE stand in runs of HELD_WORDS of a text, given as ``triples``."""
    words, at = words_of(lines, among)
    held = [False] * len(words)
    for i, run in enumerate(zip(*(words[k:] for k in range(HELD_WORDS)), strict=False)):
        if run in triples:
            held[i : i + HELD_WORDS] = [True] * HELD_WORDS
    total, part = Counter(at), Counter(i for i, h in zip(at, held, strict=True) if h)
    return [i for i in among if total[i] and part[i] < HELD_SHARE * total[i]]


def is_copy(mail: Mail, earlier: Mail) -> bool:
    """Whether a mail, what is marked in it as quoted aside, repeats an earlier one, edits aside, and has no passage of its own beside it.

    A passage is a line the earlier mail does not hold, unless it stands for a short line of that mail, or belongs to the signature and notices under the mail.
    """
    lines, written = mail.lines, mail.written()
    new = set(_unheld(lines, written, _triples(earlier.words)))
    under = len(written)
    while under and (written[under - 1] in new or not _WORD.search(lines[written[under - 1]])):
        under -= 1
    frame = next((i for i in written[under:] if any(p.search(lines[i]) for p in (DEVICE, NOTICE, RULE, CLOSING, CONTACT))), len(lines))
    new = [i for i in sorted(new) if i < frame]
    if not new:
        return True
    if any(len(_WORD.findall(lines[i])) > REPLACED_WORDS for i in new):
        return False
    theirs = earlier.lines
    back = _triples(words_of(lines, written)[0])
    lost = [theirs[i].rstrip()[-1:] for i in _unheld(theirs, list(range(len(theirs))), back) if len(_WORD.findall(theirs[i])) <= REPLACED_WORDS]
    for i in new:
        end = lines[i].rstrip()[-1:]
        same = next((k for k, x in enumerate(lost) if x == end or x.isalnum() and end.isalnum()), None)
        if same is None:
            return False
        lost.pop(same)
    return True


def _mostly(at: list[int], marks: list[bool]) -> list[int]:
    """The lines of whose words more than half are marked."""
    total, held = np.bincount(at), np.bincount(at, weights=marks)
    return np.flatnonzero((total > 0) & (held > total / 2)).tolist()


def _marked(mail: Mail, parts: Iterable[list[str]]) -> list[int]:
    automaton = SuffixAutomaton()
    for part in parts:
        automaton.add(part)
    return _mostly(mail.line_of, automaton.inherited(mail.words, INHERITED_WORDS))


def inherited_lines(mail: Mail, thread: SuffixAutomaton, earlier: list[Mail]) -> list[int]:
    """The lines of a mail (from 0) of whose words more than half are inherited from earlier mails, whose words ``thread`` holds.

    ``earlier`` are those with which the mail has a passage in common, in their order. A copy inherits only what was there before the first mail it repeats. Inherited lines a
    mail begins with, which the earlier mails themselves have only as quotations, stay: who wrote them is not known, and they stand here as the message.
    """
    if not mail.words or not earlier:
        return []
    marks = thread.inherited(mail.words, INHERITED_WORDS)
    if not any(marks):
        return []
    first = next((k for k, x in enumerate(earlier) if is_copy(mail, x)), len(earlier))
    if not first:
        return []
    found = _mostly(mail.line_of, marks) if first == len(earlier) else _marked(mail, (x.words for x in earlier[:first]))
    opening = []
    for i in mail.written():
        if _WORD.search(mail.lines[i]):
            if i not in found:
                break
            opening.append(i)
    if opening:
        known = _marked(mail, (words_of(x.lines, x.written())[0] for x in earlier[:first]))
        found = sorted(set(found) - (set(opening) - set(known)))
    return found


def _thread_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive by thread and part, in the order of time: each part has one automaton, against which its mails are matched before they are added to it."""
    thread = part = None
    automaton, held = SuffixAutomaton(), {}
    for batch in batches:
        ids, out = [], []
        for row in batch.to_pylist():
            if (row["thread"], row["part"]) != (thread, part):
                thread, part = row["thread"], row["part"]
                automaton, held = SuffixAutomaton(), {}
            mail = Mail.read(row["text"], row["quoted"], row["forwarded"])
            if row["sources"]:
                found = inherited_lines(mail, automaton, [x for _, x in sorted((held[k] for k in set(row["sources"])), key=lambda x: x[0])])
                if found:
                    ids.append(row["id"])
                    out.append(found)
            if row["source"]:
                automaton.add(mail.words)
                held[row["id"]] = len(held), mail
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "inherited": pa.array(out, pa.list_(pa.int32()))})


def _mails_of(batch: pa.RecordBatch) -> Iterator[Mail]:
    for text, quoted, forwarded, alone in zip(*(batch.column(c).to_pylist() for c in ("text", "quoted", "forwarded", "unquoted")), strict=True):
        yield Mail.read(text, sorted(set(quoted) - set(alone)) if alone else quoted, forwarded)


def _ending_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, senders, depths, prints, texts = [], [], [], [], []
        for mail, ident, sender, inherited in zip(_mails_of(batch), *(batch.column(c).to_pylist() for c in ("id", "sender", "inherited")), strict=True):
            for depth, suffix, copies in endings_of(mail, inherited or ()):
                ids.append(ident)
                senders.append(sender)
                depths.append(depth)
                prints.append(suffix)
                texts.append(copies)
        yield pa.record_batch({"id": pa.array(ids, pa.int64()), "sender": pa.array(senders, pa.string()), "depth": pa.array(depths, pa.int32()), "print": pa.array(prints, pa.int64()), "copies": pa.array(texts, pa.list_(pa.int64()))})


def _own_runner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("inherited", "ending")]
        out = [mail.own(i or (), e or 0) for mail, i, e in zip(_mails_of(batch), *columns, strict=True)]
        yield pa.record_batch({"id": batch.column("id"), "own": pa.array(out, pa.list_(pa.int32()))})


def recurring_marks(marked: DataFrame) -> DataFrame:
    """``print`` of the marked lines that are part of what was written: lonely in most of the texts that hold them, and in enough texts.

    Texts count once however many copies they have, and a thread once: of the orders of ``copies``, and the threads, the one with the fewest values counts.
    """
    orders = F.concat("copies", F.array(F.when(F.col("thread").isNull(), F.xxhash64("id")).otherwise(F.xxhash64("thread"))))
    each = marked.select("print", "alone", F.posexplode(orders).alias("order", "value"))
    each = each.groupBy("print", "order", "value").agg(F.max("alone").alias("alone"))
    counts = each.groupBy("print", "order").agg(F.sum(F.col("alone").cast("int")).alias("alone"), F.count("*").alias("n"))
    counts = counts.groupBy("print").agg(F.min("alone").alias("alone"), F.min(F.col("alone") / F.col("n")).alias("share"))
    return counts.where((F.col("alone") >= RECURRING_MARKED) & (F.col("share") >= LONELY_SHARE)).select("print")


def recurring_endings(ended: DataFrame) -> DataFrame:
    """``id, ending``: how many last lines of a mail its sender uses in enough mails, of which copies count once, and in a set part of them."""
    often = ended.groupBy("sender", "print").agg(F.count("*").alias("n")).where(F.col("n") >= RECURRING_ENDING).drop("n")
    each = ended.join(often, ["sender", "print"]).select("sender", "print", F.posexplode("copies").alias("order", "value")).distinct()
    counts = each.groupBy("sender", "print", "order").agg(F.count("*").alias("n")).groupBy("sender", "print").agg(F.min("n").alias("n"))
    total = counts.where("print = 0").select("sender", F.col("n").alias("all"))
    again = counts.where(F.col("print") != 0).join(total, "sender").where((F.col("n") >= RECURRING_ENDING) & (F.col("n") >= ENDING_SHARE * F.col("all")))
    return ended.join(again.select("sender", "print"), ["sender", "print"]).groupBy("id").agg(F.max("depth").alias("ending"))


def inherited_in_threads(mails: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """``id, inherited``: the lines (from 0) of the mails that stand in an earlier mail of their thread.

    Mails of a thread that hold a sampled run in common are candidates; of those, every passage of INHERITED_WORDS around such a run leads to the first mail that holds the
    whole passage, so no inherited passage is missed, whoever holds the run alone. A thread's candidates share one automaton; those of a thread of more than ``part_chars`` characters are
    dealt to parts, each with the first holders its mails need.
    """
    runs = mails.where(F.col("thread").isNotNull()).select("id", F.explode("runs").alias("run"), F.xxhash64("thread", "run").alias("key"))
    again = runs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    candidates = runs.join(again, "key").groupBy("id").agg(F.collect_set("run").alias("runs"))
    texts = mails.select("id", "thread", "received", "text", "quoted", "forwarded")
    candidates = cut(texts.join(candidates, "id"), "candidates")
    order = F.struct(F.col("received").isNotNull(), "received", "id")
    passages = candidates.select("id", "text", "runs").mapInArrow(_passage_runner, "id bigint, passage bigint")
    passages = cut(passages.join(candidates.select("id", "thread", order.alias("at")), "id").select("id", "at", F.xxhash64("thread", "passage").alias("key")), "passages")
    first = passages.groupBy("key").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select("key", F.col("first.id").alias("source"))
    meets = passages.join(first, "key").where(F.col("id") != F.col("source")).groupBy("id").agg(F.collect_set("source").alias("sources"))
    members = cut(candidates.select("id", "thread", F.length("text").alias("chars")).join(meets, "id"), "members")
    parts = members.groupBy("thread").agg(F.ceil(F.sum("chars") / part_chars).alias("parts"))
    members = members.join(parts, "thread").select("id", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "sources")
    needed = members.select(F.explode("sources").alias("id"), "part").distinct().select("id", "part", F.array().cast("array<bigint>").alias("sources"), F.lit(True).alias("source"))
    places = members.withColumn("source", F.lit(False)).unionByName(needed).groupBy("id", "part").agg(F.flatten(F.collect_list("sources")).alias("sources"), F.max("source").alias("source"))
    rows = places.join(candidates.drop("runs"), "id").withColumn("dated", F.col("received").isNotNull())
    rows = rows.repartition("thread", "part").sortWithinPartitions("thread", "part", "dated", "received", "id")
    return rows.select("thread", "part", "id", "text", "quoted", "forwarded", "sources", "source").mapInArrow(_thread_runner, "id bigint, inherited array<int>")


def newly_written(df: DataFrame, ident: str, body: str, subject: str, sender: str, received: str) -> DataFrame:
    """``ident, line_no``: the non-blank lines (from 1) of each mail that its sender newly wrote.

    Quoted history goes by its marks and introductions, forwarded mail by its header, and, however it is wrapped, by what the
    mail inherits: words in a run of ``INHERITED_WORDS`` that an earlier mail of the thread (equal subject but for reply and forward prefixes) holds, found by the thread's
    suffix automaton. A mail that repeats an earlier one and has no passage of its own is an edited copy and keeps its words. Closing, signature and notices are cut from the end,
    as are the last lines that several mails of a sender have in common, however many, copies counting once.

    Rows of one ``ident`` count once. Null, empty and blank bodies have no lines; a null subject is no thread and a null sender no sender;
    a null date counts as earliest, and ``ident`` breaks ties; other columns are ignored.
    """
    rows = df.select(
        F.col(ident).cast("bigint").alias("id"), F.col(body).alias("body"), F.col(sender).alias("sender"), F.col(received).alias("received"),
        F.nullif(F.trim(F.regexp_replace(F.lower(F.col(subject)), r"^\s*((re|fwd?|aw|wg|sv|rv|tr)\s*:\s*)+", "")), F.lit("")).alias("thread"),
    )
    one = rows.where(F.length(F.trim("body")) > 0).groupBy("id").agg(F.min(F.struct("received", "body", "sender", "thread")).alias("m")).select("id", "m.*")
    mails = cut(one.mapInArrow(_parse_runner, f"{_PARSED}, received {rows.schema['received'].dataType.simpleString()}, sender string, thread string"), "mails")
    marked = mails.where(F.size("lonely") > 0).select("id", "thread", "copies", F.inline("lonely"))
    unquoted = marked.select("id", "line", "print").join(recurring_marks(marked), "print").groupBy("id").agg(F.collect_list("line").alias("unquoted"))
    known = cut(unquoted.join(inherited_in_threads(mails), "id", "full_outer"), "known")
    texts = mails.select("id", "sender", "text", "quoted", "forwarded")
    busy = mails.groupBy("sender").agg(F.count("*").alias("n")).where((F.col("n") >= RECURRING_ENDING) & F.col("sender").isNotNull()).select("sender")
    ended = cut(texts.join(busy, "sender").join(known, "id", "left").mapInArrow(_ending_runner, "id bigint, sender string, depth int, print bigint, copies array<bigint>"), "ended")
    told = known.join(recurring_endings(ended), "id", "full_outer")
    own = texts.drop("sender").join(told, "id", "left").mapInArrow(_own_runner, "id bigint, own array<int>")
    return own.select(F.col("id").cast(df.schema[ident].dataType).alias(ident), F.explode("own").alias("line_no"))

