"""Personal data replaced by surrogates: keyed, of the same kind, format, script and gender, and distinct.

Entities are found in the texts and counted over the corpus. Each distinct entity gets a surrogate from a keyed stream;
two entities that draw the same one, or one that exists in the corpus, draw again, from wider spaces after a few draws;
those that still find none get the free values of their format by rank. Every mention of an entity then gets its surrogate in the mention's own layout, so mentions of one entity stay mentions of one entity.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import date
from itertools import count
from math import gcd, prod

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undercroft.operators.rows import running_totals
from undercroft.session import stage

# Forms of address and the gender they tell.
TITLES = {
    "mr": "m", "mister": "m", "sir": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "don": "m",
    "г-н": "m", "господин": "m", "κύριος": "m",
    "mrs": "f", "ms": "f", "miss": "f", "madam": "f", "frau": "f", "señora": "f", "sra": "f", "srta": "f", "señorita": "f",
    "madame": "f", "mme": "f", "mademoiselle": "f", "doña": "f", "г-жа": "f", "госпожа": "f", "κυρία": "f",
    "dr": "n", "prof": "n", "doctor": "n", "professor": "n",
}
# Syllables and endings that surrogate names are put together from, by script and gender.
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa ra re ro sa se so ta te to va ve vo",
    "cyrillic": "ба бе бо ва ве во га да де до за ка ко ла ле ло ма ме мо на не но па по ра ре ро са се со та те то",
    "greek": "βα γα δα δε ζα θα κα κο λα λε λο μα με μο να νε νο πα πο ρα ρε ρο σα σε σο τα τε το φα φι",
}
ENDINGS = {
    "latin": {"m": "n r s k rd", "f": "na ra lia sa tta", "n": "nt ly st mb ris"},
    "cyrillic": {"m": "н р к м д", "f": "на ра лия са та", "n": "нь рь ль сь ть"},
    "greek": {"m": "νος ρος λης κης μας", "f": "να ρα λη κη σα", "n": "νι ρι λι κι σι"},
}
_ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\w)|(?<!\w)\+\d{7,14}(?!\w)"
_WORDS = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_NAME = r"[^\W\d_][^\W\d_]+"
# How keys of common services begin, and what names of settings hold a secret.
_PREFIX = r"gh[pousr]_|sk_(?:live|test)_|xox[abprs]-|AIza|glpat-|eyJ"
_SETTING = (r"(?:[\w-]*[_-])?(?:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|password|passwd|pwd)")
_PATTERN = re.compile(
    rf"(?P<token>(?<!\w)(?:{_PREFIX})[\w.-]{{16,}}(?<=\w))"
    rf"|(?P<setting>(?<!\w)(?i:{_SETTING})[\"']?\s*[:=]\s*[\"']?(?P<held>[\w+/~.-]{{8,}}={{0,2}}))"
    r"|(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<ipv4>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<secret>(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    rf"|(?P<phone>{_PHONE})"
    rf"|(?P<name>(?<!\w)(?i:(?P<title>{_WORDS}))\.?\s+(?P<names>{_NAME}(?:[ -]{_NAME}){{0,2}}))")
_PHONE_ALONE = re.compile(_PHONE)
#: A text without any of these holds no entity.
_TRIGGER = re.compile(rf"\d[ .-]?\d|@|A[KS]IA|{_PREFIX}|[:=]\s*[\"']?[\w+/~.-]{{8}}|(?<!\w)(?i:{_WORDS})\.?\s")
#: A round number in groups of thousands, which is no phone number.
_ROUND = re.compile(r"\d{2,3}([ .])000(?:\1[0]{3})*")
#: Fewest and most digits of a phone number.
PHONE_DIGITS, PHONE_MOST = 7, 15
_YEAR_FIRST = re.compile(r"(\d{4})([-./ ])(\d{1,2})\2(\d{1,2})(?!\d)")
_YEAR_LAST = re.compile(r"(\d{1,2})([-./ ])(\d{1,2})\2(\d{4})(?!\d)")
_YEARS = re.compile(r"(?:1[5-9]|20)\d\d(?:[ .-](?:1[5-9]|20)\d\d)+")
#: Thousands parted by points, and by spaces; the second is an amount only beside a unit.
_AMOUNT, _SPACED = re.compile(r"[1-9]\d{0,2}(?:\.\d{3})+"), re.compile(r"[1-9]\d{0,2}(?: \d{3})+")
_UNIT_BEFORE, _UNIT_AFTER = re.compile(r"[€$£¥₽]\s?$|(?:EUR|USD|GBP|CHF|Fr\.)\s$"), re.compile(r"\s?[€$£¥₽%]|\s(?i:eur|euros?|usd|gbp|chf|dollars?|pounds?|kg|km|tons?)(?!\w)")
_BOOK = re.compile(r"(?i:isbn)(?:-1[03])?:?\s*$")
#: Draws that keep the nearest form of an entity: zeros of a phone number, lengths of an address's parts.
_NEAR = 4


@dataclass(frozen=True)
class SurrogateConfig:
    #: The secret that surrogates depend on; another key gives other surrogates.
    key: str
    #: Draws after which an entity without a free surrogate gets one by rank.
    rounds: int = 64


def script_of(word: str) -> str:
    for c in word:
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
    return "latin"


def _dated(value: str) -> bool:
    """Whether a group of numbers begins with a day of the calendar."""
    for pattern, order in ((_YEAR_FIRST, ((1, 3, 4),)), (_YEAR_LAST, ((4, 3, 1), (4, 1, 3)))):
        m = pattern.match(value)
        for year, month, day in order if m else ():
            try:
                return date(*(int(m.group(i)) for i in (year, month, day))).year >= 1000
            except ValueError:
                continue
    return False


def _other_number(text: str, start: int, stop: int) -> bool:
    """Whether what looks like a phone number is a date, a range of years, an amount or a book's number."""
    value = text[start:stop]
    return bool(
        _ROUND.fullmatch(value) or _dated(value) or _YEARS.fullmatch(value) or _AMOUNT.fullmatch(value)
        or _SPACED.fullmatch(value) and (_UNIT_BEFORE.search(text[max(0, start - 5):start]) or _UNIT_AFTER.match(text, stop))
        or _BOOK.search(text[max(0, start - 10):start]))


def _phone(text: str, start: int, stop: int) -> tuple[int, int, str, str] | None:
    value = text[start:stop]
    # The country code stays: with or without it a number is the same.
    country = re.match(r"\+\d{1,3}[ .-]", value)
    at = start + (country.end() if country else 0)
    canonical = re.sub(r"\D", "", text[at:stop])
    if not PHONE_DIGITS <= len(canonical) <= PHONE_MOST or _other_number(text, start, stop):
        return None
    return at, stop, "phone", canonical


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, canonical form) of the mentions in a text, in order and apart from each other.

    Words of names are entities of their own (`given` with the gender its title tells, `surname`), so a later mention
    of a part of a name gets the same word. The first word of a name of several words is given, the others surnames.
    Other places of the text that hold such a word, with a capital and without a title, mention it as well.
    """
    if not _TRIGGER.search(text):
        return []
    out = []
    for m in _PATTERN.finditer(text):
        kind, value = m.lastgroup, m.group(0)
        if m.group("name"):
            words = [w for w in re.finditer(_NAME, m.group("names")) if w.group(0)[0].isupper()]
            if not words or words[0].start():
                continue
            gender = TITLES[m.group("title").lower()]
            for i, w in enumerate(words):
                kind = f"given:{gender}" if i == 0 and len(words) > 1 else "surname"
                at = m.start("names") + w.start()
                out.append((at, at + len(w.group(0)), kind, w.group(0).lower()))
            continue
        kind = next(k for k in ("token", "setting", "email", "ipv4", "iban", "secret", "ssn", "card", "phone") if m.group(k))
        start, stop = m.span("held") if kind == "setting" else m.span()
        if kind == "phone":
            found = _phone(text, start, stop)
            out += [found] if found else []
            continue
        canonical = text[start:stop]
        if kind == "setting":
            # A word of prose behind a colon is no key.
            if not (any(c.isdigit() for c in canonical) and any(c.isalpha() for c in canonical)):
                continue
            kind = "token"
        elif kind == "card":
            canonical = re.sub(r"[ -]", "", value)
            if luhn_digit(canonical[:-1]) != canonical[-1] or _BOOK.search(text[max(0, start - 10):start]):
                # No card; grouped digits may still hold a phone number.
                out += [e for e in (_phone(text, *p.span()) for p in _PHONE_ALONE.finditer(text, start, stop)) if e]
                continue
        elif kind == "iban":
            canonical = re.sub(r"[ -]", "", value)
        elif kind == "email":
            canonical = value.lower()
        out.append((start, stop, kind, canonical))
    names = {text[a:b]: (kind, canonical) for a, b, kind, canonical in reversed(out) if kind[0] == "g" or kind == "surname"}
    if names:
        taken = [(a, b) for a, b, _, _ in out]
        for w in re.finditer(_NAME, text):
            if w.group(0) in names:
                i = bisect_right(taken, (w.start(), len(text)))
                if (i == 0 or taken[i - 1][1] <= w.start()) and (i == len(taken) or taken[i][0] >= w.end()):
                    out.append((w.start(), w.end(), *names[w.group(0)]))
        out.sort()
    return out


class Stream:
    """Numbers drawn from a keyed hash of an entity and the number of the draw."""

    def __init__(self, key: str, kind: str, canonical: str, turn: int):
        self.seed = f"{kind}\0{turn}\0{canonical}".encode("utf-8", "surrogatepass")
        self.key, self.block, self.pool = hashlib.sha256(key.encode()).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool = hashlib.blake2b(self.seed, key=self.key, salt=self.block.to_bytes(8, "little")).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:8], "little"), self.pool[8:]
        return value % n

    def like(self, text: str) -> str:
        """Digits for digits, letters for letters of the same case and script, everything else as it is."""
        out = []
        for c in text:
            if c.isdigit():
                out.append(str(self.below(10)))
            elif c.isalpha():
                letters = _ALPHABETS[script_of(c)]
                x = letters[self.below(len(letters))]
                out.append(x.upper() if c.isupper() else x)
            else:
                out.append(c)
        return "".join(out)


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def _card(body: str, off: int) -> str:
    return body + str((int(luhn_digit(body)) + off) % 10)


def _iban(country: str, body: str) -> str:
    number = "".join(str(int(c, 36)) for c in body + country + "00")
    return f"{country}{98 - int(number) % 97:02d}{body}"


def _kept(parts: Sequence[str]) -> int:
    """How many parts of an address stay as they are: those that make it a private one."""
    return 1 if parts[0] in ("10", "127") else 2 if list(parts[:2]) == ["192", "168"] else 0


#: Kinds whose formats hold a bounded number of values; names and mailboxes grow draw by draw.
_BOUNDED = ("ipv4", "card", "iban", "secret", "ssn", "phone")
_SECRET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_OCTETS = [str(i) for i in range(256)]
_PUBLIC = [str(i) for i in range(1, 224) if i not in (10, 127, 172, 192)]
#: Private addresses by their first two parts, the reserved ones from 240.0 on behind them.
_PRIVATE = ["192.168", *(f"172.{i}" for i in range(16, 32)), *(f"10.{i}" for i in range(256)),
            *(f"{a}.{b}" for a in range(240, 256) for b in range(256))]


def pool_of(kind: str, canonical: str) -> str:
    """The widest format of a bounded kind that an entity's surrogate may have. Pools of one kind share no value."""
    if kind == "ipv4":
        parts = canonical.split(".")
        return "127.0.0.0" if parts[0] == "127" else "10.0.0.0" if _kept(parts) else "1.0.0.0"
    if kind == "card":
        return "0" * (len(canonical) - 1) + ("0" if luhn_digit(canonical[:-1]) == canonical[-1] else "1")
    if kind == "secret":
        return canonical[:4] + "A" * (len(canonical) - 4)
    shape = "".join("0" if c.isdigit() else "A" if c.isalpha() else c for c in canonical)
    return canonical[:2] + shape[2:] if kind == "iban" else shape


def _places(kind: str, pool: str) -> list[Sequence[str]]:
    """What can stand at each place of a pool's values, check digits left out."""
    if kind == "ipv4":
        first = {"127": [["127"], _OCTETS], "10": [_PRIVATE], "1": [_PUBLIC, _OCTETS]}[pool.split(".")[0]]
        return [*first, _OCTETS, _OCTETS]
    if kind == "secret":
        return [_SECRET] * (len(pool) - 4)
    free = pool[4:] if kind == "iban" else pool[:-1] if kind == "card" else pool
    return ["0123456789" if c == "0" else _ALPHABETS["latin"].upper() if c == "A" else c for c in free]


def _joined(kind: str, pool: str, chosen: Sequence[str]) -> str:
    if kind == "ipv4":
        return ".".join(chosen)
    body = "".join(chosen)
    return (pool[:4] + body if kind == "secret" else _iban(pool[:2], body) if kind == "iban"
            else _card(body, int(pool[-1])) if kind == "card" else body)


def members(key: str, kind: str, pool: str, ranks: Sequence[int]) -> list[str | None]:
    """Values of a pool by rank in a keyed order that holds each of them once; none from the pool's size on."""
    places = _places(kind, pool)
    size, draw = prod(map(len, places)), Stream(key, "order", f"{kind}\0{pool}", 0)
    start, step = draw.below(size), 1 + draw.below(size)
    while gcd(step, size) > 1:
        step = 1 + draw.below(size)
    out: list[str | None] = []
    for i in ranks:
        at, chosen = (start + i * step) % size, []
        for p in reversed(places):
            at, digit = divmod(at, len(p))
            chosen.append(p[digit])
        out.append(_joined(kind, pool, chosen[::-1]) if i < size else None)
    return out


def surrogate(key: str, kind: str, canonical: str, turn: int) -> str:
    """The canonical form of the surrogate that an entity draws in its turn-th draw."""
    draw = Stream(key, kind, canonical, turn)
    if kind == "email":
        local, domain = canonical.rsplit("@", 1)
        labels = domain.split(".")
        # Mailboxes of one domain stay at one domain.
        moved = ".".join([*(Stream(key, "label", x, 0).like(x) for x in labels[:-1]), labels[-1]])
        # Like names, locals grow draw by draw.
        grown = "".join(_ALPHABETS["latin"][draw.below(26)] for _ in range(turn // _NEAR))
        return f"{draw.like(local)}{grown}@{moved}"
    if kind == "ipv4":
        parts = canonical.split(".")
        keep = _kept(parts)
        if turn >= _NEAR:
            first = parts[:keep] or [_PUBLIC[draw.below(len(_PUBLIC))]]
            return ".".join([*first, *(_OCTETS[draw.below(256)] for _ in parts[len(first):])])
        ranges = {1: (1, 9), 2: (10, 89), 3: (100, 155)}
        return ".".join([*parts[:keep], *(str(ranges[len(p)][0] + draw.below(ranges[len(p)][1])) for p in parts[keep:])])
    if kind == "card":
        body = canonical[0] + draw.like(canonical[1:-1])
        # No valid number becomes none.
        return _card(body, 0 if luhn_digit(canonical[:-1]) == canonical[-1] else 1 + draw.below(9))
    if kind == "iban":
        return _iban(canonical[:2], draw.like(canonical[4:]))
    if kind == "secret":
        return canonical[:4] + "".join(_SECRET[draw.below(32)] for _ in canonical[4:])
    if kind == "phone":
        if turn >= _NEAR:
            return canonical[0] + "".join(str(draw.below(10)) for _ in canonical[1:])
        return canonical[0] + "".join("0" if c == "0" else str(1 + draw.below(9)) for c in canonical[1:])
    if kind.startswith("given") or kind == "surname":
        script, gender = script_of(canonical), kind.partition(":")[2] or "n"
        syllables, ends = SYLLABLES[script].split(), ENDINGS[script][gender].split()
        # Draw by draw names grow, so there is always a free one.
        parts = [syllables[draw.below(len(syllables))] for _ in range(2 + draw.below(2) + turn // 4)]
        return "".join(parts) + ends[draw.below(len(ends))]
    if kind == "token":
        begin = re.match(_PREFIX, canonical)
        begin = begin.group(0) if begin else ""
        rest = canonical[len(begin):]
        if re.fullmatch(r"[0-9a-fA-F]+", rest):
            upper = rest.upper() == rest
            letters = "ABCDEF" if upper else "abcdef"
            return begin + "".join(str(draw.below(10)) if c.isdigit() else letters[draw.below(6)] for c in rest)
        return begin + draw.like(rest)
    return draw.like(canonical)


def laid_out(mention: str, kind: str, value: str) -> str:
    """A surrogate in the layout of a mention: its spaces, marks and capitals."""
    if kind in ("phone", "card", "iban"):
        chars = iter(value)
        return "".join(next(chars, "") if c.isalnum() else c for c in mention)
    if kind.startswith("given") or kind == "surname":
        return value.upper() if mention.isupper() else value.capitalize()
    if kind == "email" and mention.isupper():
        return value.upper()
    return value


FOUND = "row_key long, at int, stop int, kind string, canonical string, mention string"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(key, *e[:2], *e[2:], text[e[0]:e[1]])
                for key, text in zip(batch.column(0).to_pylist(), (t.as_py() or "" for t in batch.column(1))) for e in entities(text)]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["row_key", "at", "stop", "kind", "canonical", "mention"])


def _drawn(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = [surrogate(key, *r) for r in zip(*(batch.column(i).to_pylist() for i in range(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(drawn, pa.string())], ["kind", "canonical", "turn", "surrogate"])
    return run


def _pools(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pools = [pool_of(*r) for r in zip(*(batch.column(i).to_pylist() for i in range(2)))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pools, pa.string())], ["kind", "canonical", "pool"])


def _members(key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, pools, ranks = (batch.column(i).to_pylist() for i in range(3))
            wanted: dict[tuple, list[int]] = {}
            for at, pool in enumerate(zip(kinds, pools)):
                wanted.setdefault(pool, []).append(at)
            values: list[str | None] = [None] * len(ranks)
            for pool, places in wanted.items():
                for at, value in zip(places, members(key, *pool, [ranks[i] for i in places])):
                    values[at] = value
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.string())], ["kind", "pool", "i", "surrogate"])
    return run


def _by_rank(waiting: DataFrame, real: DataFrame, done: DataFrame | None, cfg: SurrogateConfig) -> DataFrame:
    """(space, kind, canonical, surrogate) of the waiting entities of bounded kinds: ranked ones get ranked free values.

    Of a pool's values so many are looked at as could be taken, and one more for each that waits.
    """
    pooled = stage(waiting.mapInArrow(_pools, "kind string, canonical string, pool string"), "pii-pools")
    taken = real if done is None else real.unionAll(done.select("space", "surrogate"))
    counts = taken.groupBy(F.col("space").alias("kind")).agg(F.count(F.lit(1)).alias("taken"))
    most = pooled.groupBy("kind", "pool").agg(F.count(F.lit(1)).alias("n")).join(counts, "kind").select(
        "kind", "pool", (F.col("n") + F.col("taken")).alias("most"))
    parts = most.select("kind", "pool", "most", F.explode(F.expr("sequence(0L, (most - 1) div 65536)")).alias("part")).repartition("kind", "pool", "part")
    tried = parts.select("kind", "pool", F.explode(F.expr("sequence(part * 65536, least(part * 65536 + 65535, most - 1))")).alias("i"))
    tried = tried.mapInArrow(_members(cfg.key), "kind string, pool string, i long, surrogate string").where("surrogate is not null")
    free = tried.join(taken.select(F.col("space").alias("kind"), "surrogate"), ["kind", "surrogate"], "left_anti")
    place = {"place": F.lit(1).cast("long")}
    free = running_totals(free, ["kind", "pool"], [F.col("i")], place, "pii-free")
    ranked = running_totals(pooled, ["kind", "pool"], [F.col("canonical")], place, "pii-ranked")
    found = ranked.join(free, ["kind", "pool", "place"]).select(F.col("kind").alias("space"), "kind", "canonical", "surrogate")
    found = stage(found, "pii-placed")
    if not waiting.join(found, ["kind", "canonical"], "left_anti").isEmpty():
        raise RuntimeError("a format has fewer free values than entities")
    return found


def assign(known: DataFrame, cfg: SurrogateConfig) -> DataFrame:
    """(kind, canonical, surrogate): distinct surrogates for distinct entities, none of them an entity of the corpus.

    Words of names share one space, so a given name and a surname never become the same word. Only a corpus that holds
    more entities of a format than the format has other values is an error, as no such table exists.
    """
    space = lambda c: F.when(F.col(c).startswith("given") | (F.col(c) == "surname"), "name").otherwise(F.col(c))
    real = stage(known.select(space("kind").alias("space"), F.col("canonical").alias("surrogate")).distinct(), "pii-real")
    waiting, done = known.select("kind", "canonical"), None
    for turn in count():
        if turn == cfg.rounds:
            bounded = F.col("kind").isin(*_BOUNDED)
            placed = _by_rank(waiting.where(bounded), real, done, cfg)
            done, waiting = placed if done is None else done.unionAll(placed), waiting.where(~bounded)
        drawn = waiting.select("kind", "canonical", F.lit(turn).alias("turn")).mapInArrow(
            _drawn(cfg.key), "kind string, canonical string, turn int, surrogate string")
        drawn = drawn.select("kind", "canonical", "surrogate", space("kind").alias("space"))
        free = drawn.join(real, ["space", "surrogate"], "left_anti")
        if done is not None:
            free = free.join(done, ["space", "surrogate"], "left_anti")
        first = Window.partitionBy("space", "surrogate").orderBy("kind", "canonical")
        won = free.withColumn("place", F.row_number().over(first)).where("place = 1").select("space", "kind", "canonical", "surrogate")
        won = stage(won, "pii-won")
        done = won if done is None else done.unionAll(won)
        waiting = stage(waiting.join(won, ["kind", "canonical"], "left_anti"), "pii-waiting")
        if waiting.isEmpty():
            return done.select("kind", "canonical", "surrogate")


def _replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for text, changes in zip(batch.column(2), batch.column(3).to_pylist()):
            value, out, at = text.as_py(), [], 0
            for c in changes or ():
                out += [value[at:c["at"]], laid_out(value[c["at"]:c["stop"]], c["kind"], c["surrogate"])]
                at = c["stop"]
            texts.append(value if not changes else "".join([*out, value[at:]]))
        counts = [len(c or ()) for c in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:2], pa.array(counts, pa.int64()), pa.array(texts, pa.string())], ["row_key", "doc_id", "n_entities", "text"])


def replace_entities(docs: DataFrame, cfg: SurrogateConfig) -> tuple[DataFrame, DataFrame]:
    """Texts with surrogates, and the table of surrogates.

    First: row_key, doc_id, n_entities, text, one row per document row; null texts stay null, equal rows get equal
    texts, an empty table gives no rows, other columns are not read. Second: kind, canonical, surrogate.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text"))
    found = stage(rows.select("row_key", "text").mapInArrow(_found, FOUND).distinct(), "pii-found")
    table = assign(found.select("kind", "canonical").distinct(), cfg)
    table = stage(table, "pii-table")
    change = F.struct("at", "stop", "kind", "surrogate")
    changes = found.join(table, ["kind", "canonical"]).groupBy("row_key").agg(F.sort_array(F.collect_list(change)).alias("changes"))
    joined = rows.join(changes, "row_key", "left").select("row_key", "doc_id", "text", "changes")
    return joined.mapInArrow(_replaced, "row_key long, doc_id long, n_entities long, text string"), table
