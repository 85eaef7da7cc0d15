"""Personal data: entities are found and replaced by keyed, type-consistent surrogates."""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changeloom.llm.common import materialize, row_keys, rows

#: Given names by script and gender. A surrogate comes from the same list.
GIVEN = {
    ("latin", "female"): "Aisha Alice Amelia Ananya Anna Barbara Camille Carla Carmen Caroline Catherine Charlotte Clara Diana Elena Elizabeth Emily Emma Eva Fatima Frieda Hannah Helen Ingrid Isabel Jane Jennifer Jessica Julia Karen Lakshmi Laura Leila Linda Lucia Margaret Maria Martha Mary Monika Nicole Olivia Patricia Pooja Rebecca Sandra Sarah Sofia Susan Teresa Ursula Victoria Yasmin Yuki Zainab".split(),
    ("latin", "male"): "Adam Ahmed Alexander Amit Andrew Anthony Antonio Arjun Arthur Carlos Charles Chidi Christopher Daniel David Diego Edward Eric Felix Frank George Hans Hassan Henry Hiroshi Ibrahim Jacques James Jan John Jonathan Jose Joseph Juan Karl Kenji Kevin Klaus Kwame Louis Luis Marco Martin Matthew Michael Miguel Mohammed Nicholas Oliver Omar Patrick Paul Peter Pierre Rahul Rajesh Richard Robert Stefan Steven Thomas Walter Wei William".split(),
    ("cyrillic", "female"): "Анна Вера Галина Екатерина Елена Ирина Людмила Мария Надежда Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "male"): "Алексей Андрей Борис Владимир Дмитрий Иван Игорь Михаил Николай Олег Павел Пётр Сергей Юрий".split(),
    ("greek", "female"): "Δήμητρα Ελένη Κατερίνα Μαρία Σοφία".split(),
    ("greek", "male"): "Γιάννης Γιώργος Δημήτρης Κώστας Νίκος".split(),
    ("arabic", "female"): "زينب عائشة فاطمة مريم".split(),
    ("arabic", "male"): "أحمد حسن عمر محمد".split(),
    ("hebrew", "female"): "מרים רחל שרה".split(),
    ("hebrew", "male"): "אברהם דוד משה".split(),
    ("devanagari", "female"): "अनन्या प्रिया लक्ष्मी सीता".split(),
    ("devanagari", "male"): "अमित अर्जुन राजेश राहुल".split(),
    ("han", "female"): "桂英 晓梅 秀英 丽娜".split(),
    ("han", "male"): "国强 建国 建华 志强".split(),
    ("hangul", "female"): "민지 서연 수진 지영".split(),
    ("hangul", "male"): "민준 영호 지훈 철수".split(),
}
#: Family names that stand before a given name without a space.
FAMILY = {("han", "family"): list("陈黄李刘孙王吴徐杨张赵周朱"), ("hangul", "family"): list("강김박윤이임장정조최")}
#: Surname endings that tell gender, and the letters that surrogate surnames are made of.
ENDINGS = ("ovna", "ová", "ova", "eva", "ina", "skaya", "ska", "ov", "ev", "in", "sky", "ski", "ова", "ева", "ина", "ская", "ов", "ев", "ин", "ский", "οπούλου", "όπουλος", "ίδου", "ίδης", "άκης")
SYLLABLES = {"latin": ("bcdfghklmnprstvw", "aeiou"), "cyrillic": ("бвгдзклмнпрстф", "аеиоу"), "greek": ("βγδζκλμνπρστφ", "αεηιου")}
#: Letters of a script: first and last code point.
SCRIPTS = {"greek": ("\u0370", "\u03ff"), "cyrillic": ("\u0400", "\u04ff"), "hebrew": ("\u0590", "\u05ff"), "arabic": ("\u0600", "\u06ff"), "devanagari": ("\u0900", "\u097f"), "han": ("\u4e00", "\u9fff"), "hangul": ("\uac00", "\ud7a3")}

_LIST = {name: key for key, names in GIVEN.items() for name in names}
_WORD = r"[^\W\d_]"
_FOUND = re.compile(
    r"(?P<email>(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<ip>(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<card>(?<![\w+-])\d(?:[ -]?\d){12,18}(?!\w))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{1,4}\)|\d{2,4})(?:[ .-]{0,2}\d{2,4}){2,4}(?!\w))"
)
#: What may stand between a given name and a surname, besides initials, and stays.
_PARTICLES = "(?:al|bin|da|de|del|della|den|der|di|dos|du|el|ibn|la|le|ten|ter|van|von)"
_SURNAME = rf"{_WORD}+(?:['’-]{_WORD}+)*"
_FULL = re.compile(rf"(?<!\w)({_WORD}+(?:-{_WORD}+)?) ((?:{_WORD}\. ){{0,3}}(?:{_PARTICLES} ){{0,3}})({_SURNAME})(?!\w)")
_PAIR = re.compile(rf"(?<!\w)(?={_WORD})[^a-zа-я\W\d_](?:{_WORD}|-)+ (?:(?:{_WORD}\. )*(?:{_PARTICLES} )*)[^a-zа-я\W\d_](?:{_WORD}|['’])+")
_HINT = re.compile(r"[0-9@]")
_HEX = re.compile(r"[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]{0,4}:[0-9A-Fa-f]")
_IPV6 = re.compile(r"(?<![\w:.])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?![\w:])")
#: Titles before a name that no list has.
_TITLED = re.compile(rf"(?<!\w)(?:Mr|Mrs|Ms|Miss|Dr|Prof|Г-н|Г-жа)\.? ({_WORD}+) (?:(?:{_WORD}\. ){{0,3}}(?:{_PARTICLES} ){{0,3}})({_SURNAME})(?!\w)")
_TITLE = re.compile(r"(?:M[rsi]|Dr|Prof|Г-)")
#: Scripts without capitals: given names that stand as words, and family and given name in one.
_CASELESS = [s for s in SCRIPTS if s in ("hebrew", "arabic", "devanagari")]
_NO_CASE = re.compile("[" + "".join(f"{low}-{high}" for s, (low, high) in SCRIPTS.items() if s not in ("greek", "cyrillic")) + "]")
_ALONE = re.compile("|".join(f"(?<![{'-'.join(SCRIPTS[s])}])(?:{'|'.join(GIVEN[s, 'female'] + GIVEN[s, 'male'])})(?![{'-'.join(SCRIPTS[s])}])" for s in _CASELESS))
_JOINED = re.compile("|".join(f"{before}[{''.join(FAMILY[s, 'family'])}](?:{'|'.join(GIVEN[s, 'female'] + GIVEN[s, 'male'])})" for s, before in (("han", ""), ("hangul", "(?<![가-힣])"))))
KINDS = ["email", "iban", "ip", "ipv6", "ssn", "card", "phone", "given", "name", "surname"]


def _is_ipv6(raw: str) -> bool:
    try:
        ipaddress.IPv6Address(raw)
    except ValueError:
        return False
    return True


def luhn(digits: str) -> int:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _iban_rest(code: str) -> int:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97


def script_of(word: str) -> str:
    return next((name for name, (low, high) in SCRIPTS.items() if low <= word[:1] <= high), "latin")


def canonical(kind: str, raw: str) -> str:
    """What two mentions of one entity share: punctuation and, for mail, case do not count."""
    if kind == "email":
        return raw.lower()
    if kind in ("given", "name", "surname"):
        return raw.title() if raw.isupper() and len(raw) > 1 else raw
    if kind in ("ip", "ipv6"):
        return raw.lower()
    return re.sub(r"[^0-9A-Za-z]", "", raw)


def entities(text: str) -> list[tuple[int, int, str]]:
    """Start, end and kind of each entity, in order, without overlaps."""
    out = []
    if _HINT.search(text):
        for m in _FOUND.finditer(text):
            kind, raw = m.lastgroup, m[0]
            digits = re.sub(r"\D", "", raw)
            if kind == "iban" and (len(canonical(kind, raw)) < 15 or _iban_rest(canonical(kind, raw)) != 1):
                continue
            if kind == "card" and luhn(digits) and not (len(digits) == 16 and digits[0] in "3456"):
                continue
            if kind == "phone" and not (9 <= len(digits) <= 15 and (raw[0] in "+(" or "(" in raw or len(re.findall(r"[ .-]", raw)) >= 2)):
                continue
            out.append((m.start(), m.end(), kind))
        if _HEX.search(text):
            out += [(m.start(), m.end(), "ipv6") for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    surnames: set[str] = set()
    if _PAIR.search(text):
        at = 0
        while m := _FULL.search(text, at):
            at = m.start(3) if not m[2] else m.start(2)
            parts = m[1].split("-")
            listed = [canonical("given", p) in _LIST for p in parts]
            if listed[0] and m[1].isupper() == m[3].isupper() and m[3][0].isupper() and canonical("surname", m[3]) not in _LIST and script_of(m[1]) == script_of(m[3]):
                begin = m.start(1)
                for part, known in zip(parts, listed, strict=True):
                    out.append((begin, begin + len(part), "given" if known else "name"))
                    begin += len(part) + 1
                out.append((m.start(3), m.end(3), "surname"))
                surnames.add(m[3])
        if _TITLE.search(text):
            for m in _TITLED.finditer(text):
                if m[1][0].isupper() and m[2][0].isupper() and canonical("given", m[1]) not in _LIST and script_of(m[1]) == script_of(m[2]):
                    out += [(m.start(1), m.end(1), "name"), (m.start(2), m.end(2), "surname")]
                    surnames.add(m[2])
    if not text.isascii() and _NO_CASE.search(text):
        out += [(m.start(), m.end(), "given") for m in _ALONE.finditer(text)]
        for m in _JOINED.finditer(text):
            out += [(m.start(), m.start() + 1, "given"), (m.start() + 1, m.end(), "given")]
    if surnames:
        taken = {s for s, _, _ in out}
        again = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(surnames)))})(?!\w)")
        out += [(m.start(), m.end(), "surname") for m in again.finditer(text) if m.start() not in taken]
    out.sort()
    kept, end = [], 0
    for e in out:
        if e[0] >= end:
            kept.append(e)
            end = e[1]
    return kept


class Surrogates:
    """Replacements that depend on a key, the kind and the canonical value alone, and on the attempt where values collided."""

    def __init__(self, key: bytes):
        self.key = key
        self.order = {}
        for names in (*GIVEN.values(), *FAMILY.values()):
            ring = sorted(names, key=lambda n: hmac.digest(key, f"order|{n}".encode(), "sha256"))
            self.order |= {a: b for a, b in zip(ring, ring[1:] + ring[:1], strict=True)}

    def _stream(self, kind: str, value: str, attempt: int) -> Iterator[int]:
        block = 0
        while True:
            yield from hmac.digest(self.key, f"{kind}|{attempt}|{block}|{value}".encode(), "sha256")
            block += 1

    def _like(self, value: str, stream: Iterator[int]) -> str:
        """Letters for letters, digits for digits; a first digit stays other than 0."""
        out = []
        for k, c in enumerate(value):
            if c.isdigit():
                n = next(stream) % 10
                out.append(str(n) if n or (k and value[k - 1].isdigit()) or c == "0" else "7")
            elif "a" <= c <= "z":
                out.append(chr(97 + next(stream) % 26))
            elif "A" <= c <= "Z":
                out.append(chr(65 + next(stream) % 26))
            else:
                out.append(c)
        return "".join(out)

    def of(self, kind: str, value: str, attempt: int = 0) -> str:
        """The canonical surrogate of a canonical value; attempt -1 is a token that no form is too small for."""
        if attempt < 0:
            return f"{kind}-{hmac.digest(self.key, f'{kind}|{value}'.encode(), 'sha256').hex()[:32]}"
        stream = self._stream(kind, value, attempt)
        if kind == "email":
            local, _, domain = value.partition("@")
            host = self._like("aaaaaa", self._stream("domain", domain, 0))
            more = "".join(str(next(stream) % 10) for _ in range(attempt // 4))  # where the mailboxes of that form are used up
            return f"{self._like(local, stream)}{more}@{host}.example.{domain.rpartition('.')[2]}"
        if kind == "ip":
            return ".".join(str(1 + (next(stream) * 256 + next(stream)) % 254) for _ in range(4))
        if kind == "card":
            new = value[0] + self._like(value[1:-1], stream)
            last = next(d for d in "0123456789" if luhn(new + d) == 0)
            return new + (last if luhn(value) == 0 else str((int(last) + 1 + next(stream) % 9) % 10))
        if kind == "iban":
            rest = self._like(value[4:], stream)
            return f"{value[:2]}{98 - _iban_rest(value[:2] + '00' + rest):02d}{rest}"
        if kind == "given":
            return self.order[value]
        if kind == "ipv6":
            groups = [len(g) and max(len(g), min(4, len(g) + attempt // 2)) for g in value.split(":")]  # longer ones where short ones are used up
            return ":".join("123456789abcdef"[next(stream) % 15] + "".join("0123456789abcdef"[next(stream) % 16] for _ in range(n - 1)) if n else "" for n in groups)
        if kind in ("name", "surname"):
            ending = next((e for e in ENDINGS if value.endswith(e) and len(value) > len(e) + 1), "")
            hard, soft = SYLLABLES[script_of(value)]
            stem = max(3, len(value) - len(ending)) + attempt
            word = "".join((hard, soft)[k % 2][next(stream) % len((hard, soft)[k % 2])] for k in range(stem))
            return word.capitalize() + ending
        if kind == "phone":
            lead = 1 if len(value) >= 11 else 0
            return value[:lead] + self._like(value[lead:], stream)
        return self._like(value, stream)

    def written(self, kind: str, raw: str, new: str) -> str:
        """A canonical surrogate in the format of a mention."""
        if new.startswith(f"{kind}-"):
            return new
        if kind in ("given", "name", "surname"):
            return new.upper() if raw.isupper() and len(raw) > 1 else new
        if kind in ("ip", "ipv6"):
            return new.upper() if raw.isupper() else new
        if kind == "email":
            return new.upper() if raw.isupper() else new
        letters = iter(new)
        return "".join(next(letters) if c.isalnum() else c for c in raw)

    def replace(self, text: str, found: list[tuple[int, int, str]], other: dict[tuple[str, str], str]) -> str:
        out, at = [], 0
        for start, end, kind in found:
            raw = text[start:end]
            value = canonical(kind, raw)
            new = other.get((kind, value)) or self.of(kind, value)
            out += [text[at:start], self.written(kind, raw, new)]
            at = end
        return "".join([*out, text[at:]])


def _mentions(parts: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    make = Surrogates(key)
    for part in parts:
        out = set()
        for i, text in zip(part.column(0).to_pylist(), pc.fill_null(part.column(1), "").to_pylist(), strict=True):
            for start, end, kind in entities(text):
                out.add((i, kind, canonical(kind, text[start:end])))
        out = sorted(out, key=str)
        yield rows("doc_id long, kind string, value string, surrogate string", [x[0] for x in out], [x[1] for x in out], [x[2] for x in out], [make.of(x[1], x[2]) for x in out])


def _again(parts: Iterator[pa.RecordBatch], key: bytes) -> Iterator[pa.RecordBatch]:
    make = Surrogates(key)
    for part in parts:
        kind, value, attempt = (part.column(k).to_pylist() for k in range(3))
        yield rows("kind string, value string, attempt int, surrogate string", kind, value, attempt, [make.of(*x) for x in zip(kind, value, attempt, strict=True)])


def _replaced(parts: Iterator[pa.RecordBatch], key: bytes, at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    make = Surrogates(key)
    for part in parts:
        texts, n, spans = [], [], []
        for text, other in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(), strict=True):
            found = entities(text) if text else []
            n.append(len(found))
            spans.append(",".join(f"{kind}:{start}:{end}" for start, end, kind in found))
            texts.append(make.replace(text, found, {(o["kind"], o["value"]): o["surrogate"] for o in other or []}) if found else text)
        columns = [pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(part.columns[:-1])]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(n, pa.int64()), pa.array(spans, pa.string())], names=names)


def collisions(mentions: DataFrame, key: bytes, most: int = 40) -> DataFrame:
    """Other surrogates, ``kind, value, surrogate``, for values whose first one another value has too, or that is itself a value of the corpus.

    Of values that share a surrogate the smallest keeps it. The others try again, with an attempt number in the
    keyed hash, until all differ; each round handles what collided in the round before. Mailboxes, surnames and groups of IPv6 addresses grow with the attempts, so
    short ones never run out. Of other forms, a value that has found none after ``most`` attempts, where nearly all that there are stand in the corpus, becomes a token of kind and hash.
    """
    values = materialize(mentions.select("kind", "value", "surrogate").distinct().where("kind <> 'given'"))
    real = values.select("kind", F.col("value").alias("surrogate"))

    def bad(some: DataFrame, taken: DataFrame) -> DataFrame:
        first = some.groupBy("kind", "surrogate").agg(F.min("value").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        twice = some.join(first, ["kind", "surrogate"]).where("value <> first").select("kind", "value")
        return twice.unionByName(some.join(taken, ["kind", "surrogate"], "left_semi").select("kind", "value")).distinct()

    todo = materialize(bad(values, real))
    done: DataFrame | None = None
    for attempt in range(1, most + 1):
        if todo.isEmpty():
            break
        tried = materialize(todo.withColumn("attempt", F.lit(attempt)).mapInArrow(partial(_again, key=key), "kind string, value string, attempt int, surrogate string"))
        taken = real.unionByName(values.join(todo, ["kind", "value"], "left_anti").select("kind", "surrogate"))
        if done is not None:
            taken = taken.unionByName(done.select("kind", "surrogate"))
        still = materialize(bad(tried, taken))
        good = tried.join(still, ["kind", "value"], "left_anti").select("kind", "value", "surrogate")
        done = materialize(good if done is None else done.unionByName(good))
        todo = still
    if not todo.isEmpty():
        last = todo.withColumn("attempt", F.lit(-1)).mapInArrow(partial(_again, key=key), "kind string, value string, attempt int, surrogate string").select("kind", "value", "surrogate")
        done = last if done is None else done.unionByName(last)
    return done if done is not None else values.limit(0)


def replace_entities(df: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns and rows of a table with the entities in its texts replaced, and ``n_entities`` and ``entities`` (kind:start:end in the input, comma-joined).

    Found are mail addresses, IBANs, IPv4 and IPv6 addresses, social security, card and phone numbers, names that begin with a
    known given name, in capitals too, and names after a title; a surname of a text is found again in that text. Where a script has no
    capitals, a known given name is found as a word by itself (Hebrew, Arabic, Devanagari) or behind a known family name (Han, Hangul); other words of a name stay there. A surrogate depends on the key and the value, so all mentions of an entity, in any text and any
    punctuation, get one surrogate; it keeps kind, length and format, a card's checksum, a name's gender and script. Two values
    never share one, and none is a value of the corpus, but for listed given and family names, which are permuted within their list. A null text stays null and an empty one empty;
    null ids and repeated rows stay. A column named as an added one is replaced.

    Surrogates are computed where the text is read. Only values that collided are joined in, by document, from a written
    table, so that its true size is known before any text moves: texts are shuffled only where it is too large to broadcast.
    """
    secret = hashlib.sha256(key.encode()).digest()
    df = df.select(*[c for c in df.columns if c not in ("n_entities", "entities")])
    keyed = row_keys(df, id_col, "__row")
    pairs = keyed.select("__row", F.col(text_col).cast("string").alias("text"))
    mentions = materialize(pairs.mapInArrow(partial(_mentions, key=secret), "doc_id long, kind string, value string, surrogate string"))
    other = collisions(mentions, secret)
    by_row = materialize(mentions.drop("surrogate").join(other, ["kind", "value"]).groupBy(F.col("doc_id").alias("__row")).agg(F.collect_set(F.struct("kind", "value", "surrogate")).alias("__other")))
    work = keyed.join(by_row, "__row", "left").select(*df.columns, "__other")
    schema = df.withColumn(text_col, F.col(text_col).cast("string")).withColumn("n_entities", F.lit(0).cast("long")).withColumn("entities", F.lit("")).schema
    names = [f.name for f in schema]
    return work.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(partial(_replaced, key=secret, at=df.columns.index(text_col), names=names), schema)
