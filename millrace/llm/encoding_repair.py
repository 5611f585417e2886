"""Garbled text from a wrong character encoding: best-first search for the cheapest reachable text.

A text is cut at blanks; only pieces with non-ASCII characters, entities or escaped bytes can be garbled. From such a piece a
search runs over texts: an edge encodes the text with one encoding and decodes the bytes with another, or unescapes; visited texts
are kept by hash; the frontier is ordered by a character-plausibility cost plus a price per edge. The cheapest text reached wins if
it is cheaper than the start by a margin. A text whose next step alone costs as much as the best found is not followed, as no
text costs less than nothing, so the search is exact. An edge into UTF-8 or UTF-7 carries its own proof, since its sequences
rarely are valid by chance. An edge between two other encodings does not: it is an edge of a second best-first search, over
states of the whole text, and exists only where the pieces of the text agree on it with enough gain in sum; it then holds for every
piece that gains by it. Where only part of a piece is garbled, each run of it is judged with its neighbours alone, so clean
characters around it, in any script, have no vote. That needs a single-byte encoding taken; a swap of part of a piece needs
agreement of whole pieces of the text. A text that still holds lost or stray characters where the search ends is in its terminal
state "lost": garbled, and restored only as far as it goes.

Escapes. Entities, \\u00XX, \\xXX, quoted-printable and percent escapes of multi-byte sequences are unescaped only if a decoding
step follows; escapes in addresses (a piece with "://" or starting with "www.") are no fault and stay. An escape of a right
character alone is no wrong decoding and is left as it is.

Whole texts are searched, of any length; pieces repeat, so each worker remembers results up to a bound.
Null, empty and ASCII texts without entities or escapes are never garbled. Ties in cost go to the shorter list of steps, then to
the text that sorts first. Each row is judged alone, so repeated rows get equal results; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import heapq
import html
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import spread

SCHEMA = "doc_id bigint, restored string, complete boolean, pieces int, steps string, cost_before double, cost_after double"

#: Encodings that bytes of UTF-8 are often taken for.
TAKEN_FOR = (
    "cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp866", "koi8-r", "cp1253", "cp1254", "iso8859-2",
    "gb18030", "big5", "shift_jis", "euc-kr",
)
#: Pairs (taken for, really) of encodings without the proof that UTF-8 carries.
SWAPS = tuple(
    (wrong, right)
    for right, wrongs in (
        ("cp1252", ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "cp1253", "koi8-r", "cp866")),
        ("cp1251", ("cp1252", "latin-1", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "cp437", "iso8859-5")),
        ("koi8-r", ("cp1252", "latin-1", "cp1251", "cp866")),
        ("cp866", ("cp1252", "latin-1", "cp1251", "koi8-r", "cp437")),
        ("iso8859-5", ("cp1251", "cp1252", "latin-1")),
        ("gb18030", ("cp1252", "latin-1", "cp1251", "cp1250", "cp437", "cp850", "mac_roman", "koi8-r", "cp866", "big5")),
        ("big5", ("cp1252", "latin-1")),
        ("shift_jis", ("cp1252", "latin-1")),
        ("mac_roman", ("cp1252", "latin-1", "cp437")),
        ("cp437", ("cp1252", "latin-1")),
        ("cp850", ("cp1252", "latin-1")),
    )
    for wrong in wrongs
)
#: Of two encodings that share most letters, the rarer costs more; where a text proves it, the pieces taken for the other follow.
RIVALS = {"iso8859-2>utf-8": "cp1250>utf-8"}
DEARER = 0.05
BY_WRONG = {w: [r for v, r in SWAPS if v == w] for w in dict.fromkeys(v for v, _ in SWAPS)}
MARGIN, STEP, SWAP_MARGIN, SWAP_SUM, SWAP_ANY = 0.3, 0.15, 0.8, 2.0, 0.1
PIECE = re.compile(r"[^ \t\r\n]+")
#: Cost a non-ASCII character up to which a text is plausible.
PLAUSIBLE = 0.5
NON_ASCII = re.compile(r"[^\x00-\x7f]")
#: Where Latin letters meet those of another script, as in prose without blanks.
SCRIPTS = re.compile("(?<=[A-Za-zÀ-ɏ])(?=[Ͱ-ԯぁ-ヿ一-鿿가-힣])|(?<=[Ͱ-ԯぁ-ヿ一-鿿가-힣])(?=[A-Za-zÀ-ɏ])")
#: Bytes of a multi-byte sequence written as escapes: \\u00c3, \\xc3, =C3 or %C3, at least two of them.
ESCAPED = re.compile(r"(?:\\u00[89a-fA-F][0-9a-fA-F]){2,}|(?:\\x[89a-fA-F][0-9a-fA-F]){2,}|(?:=[89A-F][0-9A-F]){2,}|(?:%[89a-fA-F][0-9a-fA-F]){2,}")
ADDRESS = re.compile(r"://|\Awww\.", re.I)
UTF7, UTF7_RUN = re.compile(r"\+([A-Za-z0-9+/]{3,})-"), re.compile(r"\+(?:([A-Za-z0-9+/]{3,})(?:-|(?![A-Za-z0-9+/]))|-)")
SUSPECT_TEXT = r"[^\x00-\x7F]|&#?\w+;|\+[A-Za-z0-9+/]{3,}-|\\(?:u00|x)[89a-fA-F]|[=%][89a-fA-F][0-9a-fA-F][=%][89a-fA-F]"
SUSPECT = re.compile(SUSPECT_TEXT)
SEQUENCE = re.compile(
    rb"[\xc2-\xdf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xe0[\xa0-\xbf][\x80-\xbf]|\xed[\x80-\x9f][\x80-\xbf]|[\xf1-\xf3][\x80-\xbf]{3}|\xf0[\x90-\xbf][\x80-\xbf]{2}|\xf4[\x80-\x8f][\x80-\xbf]{2}"
)
_SINGLE = {e for e in TAKEN_FOR if e not in ("gb18030", "big5", "shift_jis", "euc-kr")}
#: Garbled text may have been lower-cased afterwards; lead characters are put back, with or without the ambiguous one.
_RAISED = (("raise", str.maketrans("ãÿ", "ÃŸ")), ("raise", str.maketrans("ãâÿ", "ÃÂŸ")))
HEX, STRAY_PLUS = re.compile(r"[0-9a-fA-F]{2}(?![0-9a-fA-F])"), re.compile(r"\+(?!-)")
DIGIT, CONTROL = re.compile(r"[0-9]"), re.compile("[\x80-\x9f]")
LOST = re.compile("â€|[�\x80-\x84\x86-\x9f]")

_WHOLE = set("©®™ªº–—‘’“”„‚«»…•·°²³¹½¼¾×÷±≤≥≠≈≡√∑∏∫∞∂π∎□■→←⇒∈∉⊂∪∩∅∀∃€£¥¢§¿¡№│─┼，。：；？！、（）「」《》％＋－＝　")
_MARKS = set("\u0300\u0301\u0302\u0303\u0304\u0306\u0307\u0308\u030a\u030b\u030c\u0323\u0327\u0328\u0338")
_MONEY = set("£¥¢€")
#: Signs that stand beside numbers; a lone Cyrillic letter beside one is hardly prose.
_BESIDE = set("—–°£§€¢¥±×÷²³¼½¾")
_CYRILLIC = set("абвгдежзийклмнопрстуфхцчшщъыьэюяё")
_CYRILLIC_COMMON = set("оеаинтсрвлкмдпу")
_CENTRAL = set("ąćęłńśźżčďěňřšťůžőűğşțđ")
_LATIN1 = set("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿßœ")


def _kind(ch: str) -> str:
    """ascii letter a/A, digit 0, other ascii '.', latin l/L, cyrillic c/C, greek g/G, cjk j, symbol s, lost x."""
    if ch < "\x80":
        return ("a" if ch.islower() else "A") if ch.isalpha() else "0" if ch.isdigit() else "."
    if ch == "�" or "\x80" <= ch <= "\x9f":
        return "x"
    group = unicodedata.category(ch)
    if group in ("Co", "Cn", "Cs"):
        return "x"
    if group in ("Mn", "Mc"):
        return "m"
    if group[0] == "L":
        if ch in "ªº":
            return "s"
        code = ord(ch)
        if code < 0x250 or 0x1E00 <= code < 0x1F00 or 0xFB00 <= code < 0xFB07 or 0xFF21 <= code < 0xFF5B:
            return "L" if group == "Lu" else "l"
        if 0x400 <= code < 0x530:
            return "C" if group == "Lu" else "c"
        if 0x370 <= code < 0x400:
            return "G" if group == "Lu" else "g"
        return "j" if code >= 0x1100 else "o"
    if group == "Nd":
        return "0" if "０" <= ch <= "９" else "o"
    return "s"


_kinds: dict[str, str] = {}


def _east_asian(ch: str) -> float:
    """Common hanzi are the 3,755 of the first plane of GB 2312, whose lead bytes end at D7."""
    if "\u4e00" <= ch <= "\u9fff":
        try:
            return 0.2 if ch.encode("gb2312")[0] <= 0xD7 else 0.9
        except UnicodeEncodeError:
            return 0.9
    return 0.3 if "\u3041" <= ch <= "\u30ff" or "\uac00" <= ch <= "\ud7a3" else 3.0


def _utf7_run(body: str) -> str | None:
    """Characters of a UTF-7 run; null unless it holds whole units of plausible characters, of which a single one is below the CJK block."""
    if len(body) % 8 not in (0, 3, 6):
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
        out = raw.decode("utf-16-be")
    except (binascii.Error, UnicodeDecodeError):
        return None
    exact = base64.b64encode(raw).rstrip(b"=").decode() == body
    return out if exact and out[0] > "\x7f" and (len(out) > 1 or out < "\u3000") and all(_kind(ch) != "x" for ch in out) else None


def _from_utf7(text: str) -> str:
    """The text with its valid UTF-7 runs decoded; open runs and +- count where a closed run has proven the encoding."""
    if not any(_utf7_run(m.group(1)) for m in UTF7.finditer(text)):
        return text
    return UTF7_RUN.sub(lambda m: "+" if m.group(1) is None else _utf7_run(m.group(1)) or m.group(), text)


def _lonely(text: str, at: int) -> bool:
    """The only Cyrillic letter of a piece, beside a digit or a sign."""
    beside = text[max(0, at - 1) : at] + text[at + 1 : at + 2]
    return any(ch.isdigit() or ch in _BESIDE for ch in beside) and sum("\u0400" <= ch < "\u0530" for ch in text) == 1


def cost(text: str, lonely: bool = True) -> float:
    """How implausible the characters are where they stand; 0 for ASCII but for runs of UTF-7."""
    total, before, money = 0.0, " ", False
    if "+" in text and "-" in text:
        total += 3.0 * sum(_utf7_run(m.group(1)) is not None for m in UTF7.finditer(text))
    if text.isascii():
        return total
    for at, ch in enumerate(text):
        kind = _kinds.get(ch)
        if kind is None:
            kind = _kinds[ch] = _kind(ch)
        lower = ch.lower()
        if kind == "x":
            total += 4
        elif kind in "lL":
            total += 0.4 if lower in _LATIN1 or "\ufb00" <= ch <= "\ufb06" else 0.7 if lower in _CENTRAL else 1.6
            if kind == "L" and before in "alc":
                total += 2
        elif kind in "cC":
            total += 0.05 if lower in _CYRILLIC_COMMON else 0.25 if lower in _CYRILLIC else 1.2
            if kind == "C" and before in "calC":
                total += 0.2 if before == "C" else 2
            if lonely and before not in "cC" and _lonely(text, at):
                total += 2
        elif kind in "gG":
            total += 0.5 if ch == "π" else 0.3 if before == "g" else 1.0
        elif kind == "j":
            total += _east_asian(ch)
        elif kind == "o":
            total += 3.0
        elif kind == "m":
            total += 0.8 if ch in _MARKS else 3.0
        elif kind == "s":
            total += 0.4 if ch in _WHOLE else 1.3
            if ch in "\xa0\xad":
                total += 1.0
            after = text[at + 1] if at + 1 < len(text) else " "
            if before in "alLcCgGjA" and (ch not in "’²³°¹…”»–—×." or ch == "»" and before != "j") and after.isalpha():
                total += 2.5
            elif before in "lLcCgx" and ch not in "’²³°¹…”»–—，。：；？！、（）":
                total += 0.6
        elif kind == "A" and before in "alc":
            total += 0.3
        if kind in "alA" and before in "cCgGj" or kind in "cC" and before in "alLAgGj" or kind in "gG" and before in "alLcCj" or kind == "j" and before in "lLcCgG":
            if ch not in "rπ" or before not in "gπ":
                total += 2
        if kind in "lLgGcCs" and before in "lLgGs" and kind + before not in ("ll", "LL", "gg", "lL") and not (money and ch in _MONEY):
            total += 0.5
        before, money = kind, ch in _MONEY
    return total


def _lead_characters(encoding: str) -> re.Pattern:
    """Characters that an encoding has for the first bytes of UTF-8 sequences; a text without one has no sequence."""
    held = [bytes([b]).decode(encoding, "ignore") for b in range(0xC2, 0xF5)]
    return re.compile(f"[{re.escape(''.join(held))}]")


def _open_bytes(encoding: str) -> set[str]:
    """Control characters of the bytes from 80 to 9F that a Windows encoding leaves open."""
    return {chr(b) for b in range(0x80, 0xA0) if not bytes([b]).decode(encoding, "ignore")}


_OPEN = {encoding: _open_bytes(encoding) for encoding in ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254")}
_LEADS = {encoding: _lead_characters(encoding) for encoding in _SINGLE}


def _bytes(text: str, encoding: str) -> bytes | None:
    """Encoded; bytes that a Windows encoding leaves open stand for themselves, as most decoders have it."""
    try:
        return text.encode(encoding)
    except UnicodeEncodeError:
        if encoding not in _OPEN or not CONTROL.search(text):
            return None
    out, free = bytearray(), _OPEN[encoding]
    for ch in text:
        try:
            out += ch.encode(encoding)
        except UnicodeEncodeError:
            if ch not in free:
                return None
            out.append(ord(ch))
    return bytes(out)


def _runs(text: str, encoding: str) -> list[tuple[int, int, str, float]]:
    """(start, end, decoded, gain) of the runs of valid multi-byte sequences that get cheaper where they stand, whatever is around."""
    raw = bytes((b[0] if (b := _bytes(ch, encoding)) else 0x3F) for ch in text) if CONTROL.search(text) else text.encode(encoding, "replace")
    spans: list[list[int]] = []
    for m in SEQUENCE.finditer(raw):
        if spans and spans[-1][1] == m.start():
            spans[-1][1] = m.end()
        else:
            spans.append([m.start(), m.end()])
    out = []
    for start, end in spans:
        there, left, right = raw[start:end].decode("utf-8", "replace"), text[max(0, start - 1) : start], text[end : end + 1]
        gain = cost(left + text[start:end] + right) - cost(left + there + right)
        if gain > 0:
            out.append((start, end, there, gain))
    return out


def _partly(text: str, encoding: str, proven: bool = False) -> str:
    """Only the runs of valid multi-byte sequences that get cheaper decoded, everything else as it is.

    The text must cost half of what it did, or be plausible by and large once decoded; for the latter one run must cost half of what it
    did, by the margin, unless other pieces have proven the encoding. So the clean rest has no vote, and a rest garbled otherwise has.
    """
    runs = _runs(text, encoding)
    out, last = [], 0
    for start, end, there, _ in runs:
        out += [text[last:start], there]
        last = end
    decoded = "".join([*out, text[last:]])
    if not runs:
        return text
    price = cost(decoded)
    if price <= 0.5 * cost(text):
        return decoded
    shown = proven or any(gain >= MARGIN + STEP and cost(there) <= 0.5 * cost(text[start:end]) for start, end, there, gain in runs)
    return decoded if shown and cost(SCRIPTS.sub(" ", decoded)) <= PLAUSIBLE * len(NON_ASCII.findall(decoded)) else text


def _unescaped(text: str) -> str:
    """Entities and escaped bytes as characters; a byte becomes the character of its number."""
    plain = html.unescape(text) if "&" in text else text
    if ESCAPED.search(plain) and not ADDRESS.search(plain):
        plain = ESCAPED.sub(lambda m: "".join(chr(int(h, 16)) for h in HEX.findall(m.group())), plain)
    return plain


def _edges(text: str) -> Iterator[tuple[str, str]]:
    """(step, text) reachable by one step."""
    for name, table in _RAISED:
        if (raised := text.translate(table)) != text:
            yield name, raised
    if (plain := _unescaped(text)) != text:
        yield "unescape", plain
    if "+" in text and (plain := _from_utf7(text)) != text:
        yield "ascii>utf-7", plain
    if text.isascii():
        return
    for encoding in TAKEN_FOR:
        if encoding in _LEADS and not _LEADS[encoding].search(text):
            continue
        raw = _bytes(text, encoding)
        if raw is not None and not raw.isascii():
            try:
                yield f"{encoding}>utf-8", raw.decode("utf-8")
                continue
            except UnicodeDecodeError:
                pass
        if encoding in _SINGLE and (there := _partly(text, encoding)) != text:
            yield f"{encoding}>utf-8", there


def search(piece: str) -> tuple[str, list[str], float, float]:
    """Cheapest text, steps to it, cost before and after. The start itself if nothing is cheaper by the margin.

    Steps that carry no proof (unescaping, restoring case) must lead on into an encoding step. Where the text found still holds
    lost or stray characters, "lost" is the last step.
    """
    start = max(cost(piece), cost(_unescaped(piece)))
    best = (start, 0, piece, [])
    frontier, seen = [(start, 0, piece, [])], {piece}
    while frontier:
        _, depth, text, steps = heapq.heappop(frontier)
        if STEP * (len(steps) + 1) >= best[0]:
            continue
        for step, there in _edges(text):
            if there in seen:
                continue
            seen.add(there)
            price, way = cost(there) + DEARER * (step in RIVALS), [*steps, step]
            heapq.heappush(frontier, (price + STEP * len(way), depth + 1, there, way))
            if ">" in step:
                best = min(best, (price + STEP * len(way), len(way), there, way))
    total, _, text, way = best
    if way and total + MARGIN <= start:
        after = total - STEP * len(way)
    else:
        text, way, after = piece, [], start
    return text, [*way, "lost"] if LOST.search(text) else way, start, after


def swap(piece: str, wrong: str, right: str) -> tuple[str, float]:
    """The piece under another single-byte encoding, and how much cheaper it is.

    Where the piece has characters that the wrong encoding lacks, these stay, and so do the parts between them that gain too little.
    """
    raw = _bytes(piece, wrong)
    if raw is not None:
        try:
            there = raw.decode(right)
        except UnicodeDecodeError:
            return piece, 0.0
        return there, cost(piece, False) - cost(there, False)
    held, out, gained, part = [_bytes(ch, wrong) for ch in piece], [], 0.0, 0
    while part < len(piece):
        end = part + 1
        while end < len(piece) and (held[end] is None) == (held[part] is None):
            end += 1
        here = there = piece[part:end]
        if held[part] is not None and not here.isascii():
            try:
                there = b"".join(held[part:end]).decode(right)
            except UnicodeDecodeError:
                pass
            before, after = piece[max(0, part - 1) : part], piece[end : end + 1]
            gain = cost(before + here + after, False) - cost(before + there + after, False)
            if gain >= SWAP_MARGIN:
                gained += gain
            else:
                there = here
        out.append(there)
        part = end
    return "".join(out), gained


def swap_gains(piece: str) -> dict[tuple[str, str], float]:
    """How much cheaper the piece gets by each swap that makes it cheaper."""
    out, was = {}, cost(piece, False)
    if not was:
        return out
    for wrong, rights in BY_WRONG.items():
        raw = _bytes(piece, wrong)
        if raw is None:
            continue
        for right in rights:
            try:
                gain = was - cost(raw.decode(right), False)
            except UnicodeDecodeError:
                continue
            if gain > 0:
                out[wrong, right] = gain
    return out


def search_swaps(pieces: list[str], gains: list[dict[tuple[str, str], float]]) -> tuple[list[str], list[list[str]], list[float]]:
    """Best-first search over states of a whole text: the pieces at the first state without a further edge, with their steps and gains.

    An edge reads all pieces under another encoding; it exists where the pieces that gain SWAP_MARGIN by it gain SWAP_SUM together,
    and then holds for all that gain. The frontier is ordered by what edges gain; a state is made when its edge comes up. Every edge
    makes the text cheaper, so the search ends.
    """
    state, ways, got = list(pieces), [[] for _ in pieces], [0.0] * len(pieces)
    frontier: list[tuple] = []
    seen, depth, price = {tuple(pieces)}, 0, 0.0
    while True:
        sums: dict[tuple[str, str], float] = {}
        for mine in gains if not depth else map(swap_gains, state):
            for pair, gain in mine.items():
                if gain >= SWAP_MARGIN:
                    sums[pair] = sums.get(pair, 0.0) + gain
        edges = [(price - gain + STEP, depth + 1, pair) for pair, gain in sums.items() if gain >= SWAP_SUM]
        if not edges:
            return state, ways, got
        for edge in edges:
            heapq.heappush(frontier, (*edge, state, ways, got))
        while frontier:
            price, depth, pair, state, ways, got = heapq.heappop(frontier)
            state, ways, got = list(state), list(ways), list(got)
            for k, piece in enumerate(state):
                swapped, gain = swap(piece, *pair)
                if gain >= SWAP_ANY:
                    state[k], ways[k], got[k] = swapped, [*ways[k], ">".join(pair)], got[k] + gain
            if tuple(state) not in seen:
                seen.add(tuple(state))
                break
        else:
            return state, ways, got


_found: dict[str, tuple] = {}


def _same_way(piece: str, ways: list[str]) -> tuple[str, list[str], float, float]:
    """A piece under a step into UTF-8 that repaired others of its text; any gain is enough then."""
    was = cost(piece)
    for way in ways:
        encoding, _, right = way.partition(">")
        if right != "utf-8":
            continue
        there, raw = piece, _bytes(piece, encoding)
        if raw is not None and not raw.isascii():
            try:
                there = raw.decode("utf-8")
            except UnicodeDecodeError:
                pass
        if there == piece and encoding in _SINGLE:
            there = _partly(piece, encoding, proven=True)
        if cost(there) < was:
            return there, [way], was, cost(there)
    return piece, [], was, was


def _remember(piece: str) -> tuple:
    """Search and gains of all swaps of a piece. Pieces that differ in ASCII digits only share one search where those survive it."""
    shape = piece if "&" in piece or piece.isascii() or UTF7.search(piece) or ESCAPED.search(piece) else DIGIT.sub("0", piece)
    text, *rest = _searched(shape)
    if shape == piece:
        return text, *rest
    if text.count("0") != shape.count("0"):
        return _searched(piece)
    digits = iter(DIGIT.findall(piece))
    return DIGIT.sub(lambda _: next(digits), text), *rest


def _searched(piece: str) -> tuple:
    known = _found.get(piece)
    if known is None:
        if len(_found) > 50_000:
            _found.clear()
        text, steps, before, after = search(piece)
        gains = {} if steps and steps != ["lost"] else swap_gains(piece)
        known = (text, steps, before, after, gains)
        if len(piece) < 200:
            _found[piece] = known
    return known


def repair(text: str) -> tuple[str, bool, int, str, float, float] | None:
    """(restored, complete, garbled pieces, steps, cost before, cost after), or None where nothing is garbled."""
    pieces = [(m.start(), m.end(), m.group()) for m in PIECE.finditer(text) if SUSPECT.search(m.group())]
    if not pieces:
        return None
    results = [_remember(p) for _, _, p in pieces]
    proven = sorted({r[1][0] for r in results if len(r[1]) == 1 and ">" in r[1][0]})
    if proven:
        results = [r if r[1] else (*_same_way(p, proven), r[4]) for r, (_, _, p) in zip(results, pieces, strict=True)]
    for rare in RIVALS.keys() & proven:
        results = [
            again if r[1] == [RIVALS[rare]] and (again := (*_same_way(p, [rare]), r[4]))[3] <= r[3] + MARGIN else r
            for r, (_, _, p) in zip(results, pieces, strict=True)
        ]
    loose = [k for k, r in enumerate(results) if not r[1] or r[1] == ["lost"]]
    if any(results[k][4] for k in loose):
        for k, there, way, gain in zip(loose, *search_swaps([results[k][0] for k in loose], [results[k][4] for k in loose]), strict=True):
            if way:
                _, steps, was, now, gains = results[k]
                results[k] = there, [*way, *(["lost"] if LOST.search(there) else [])], was, now - gain, gains
    out, last, n, ways, before, after, complete = [], 0, 0, {}, 0.0, 0.0, True
    for (start, end, _), (there, steps, was, now, _) in zip(pieces, results, strict=True):
        if steps:
            n += 1
            ways["+".join(steps)] = ways.get("+".join(steps), 0) + 1
            complete = complete and steps[-1] != "lost"
        out += [text[last:start], there]
        last, before, after = end, before + was, after + now
    if not n:
        return None
    out.append(text[last:])
    whole = "".join(out)
    if "ascii>utf-7" in proven:
        whole = UTF7_RUN.sub(lambda m: m.group(1) and _utf7_run(m.group(1)) or m.group(), whole)
        if not STRAY_PLUS.search(whole):
            whole = whole.replace("+-", "+")
    return whole, complete, n, ",".join(sorted(ways, key=lambda w: (-ways[w], w))), before, after


def _repairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for batch in batches:
        rows = [(doc, *found) for doc, text in zip(batch["doc_id"], batch["text"], strict=True) if (found := repair(text))]
        if rows:
            yield pd.DataFrame(rows, columns=names)


def garbled_texts(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per garbled text: (doc_id, restored, complete, pieces, steps, cost_before, cost_after).

    complete is false where characters were lost (replacement characters, stray control codes), restored is then as far as it goes.
    """
    suspect = documents.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").rlike(SUSPECT_TEXT))
    return spread(suspect).mapInPandas(_repairs, SCHEMA)
