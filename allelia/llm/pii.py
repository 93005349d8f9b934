"""Surrogates for personal data.

Entities (e-mail addresses, telephone, card and IP numbers, bank and social-security numbers, keys, names
of people) are replaced by keyed values of the same type, format, script and gender. A surrogate is a keyed
permutation of its original within the originals of the same format: digits of digits, vowels of vowels,
first names within the names of that script and gender. So equal entities get equal surrogates everywhere
(coreference, also of a surname alone), different ones get different ones without a table of entities,
and no list grows with the corpus; `collisions` checks this over all documents, given names and surnames apart,
and `checked` reports its result. A listed first name that is a known surname of its text is that surname after a title.

Permutations of up to `SMALL` values are keyed single cycles, which leave nothing in its place, larger ones
keyed Feistel networks. Null text stays null, empty text stays empty; texts without entities are not changed.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SMALL = 20_000

# First names by script and gender.
FIRST_NAMES = {
    ("latin", "f"): "Alice Anna Barbara Carla Caroline Charlotte Chloé Elena Elizabeth Emily Emma Eva Hannah Helen Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucía Margaret Maria Marie Mary Michelle Monika Nancy Olivia Patricia Petra Rachel Sabine Sandra Sarah Sophie Susan Ursula".split(),
    ("latin", "m"): "Alejandro Andrew Anthony Antonio Brian Carlos Charles Christopher Daniel David Edward Eric François George Hans Henry Jacques James Javier Jean John Joseph José Jürgen Kevin Klaus Luis Matthew Michael Miguel Nicolas Paul Peter Pierre Richard Robert Stefan Thomas William Wolfgang".split(),
    ("cyrillic", "f"): "Анна Елена Екатерина Ирина Мария Наталья Ольга Светлана Татьяна Юлия".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Дмитрий Иван Михаил Николай Павел Сергей Юрий".split(),
    ("greek", "f"): "Αικατερίνη Άννα Βασιλική Γεωργία Ειρήνη Ελένη Κωνσταντίνα Μαρία Σοφία Χριστίνα".split(),
    ("greek", "m"): "Αθανάσιος Βασίλειος Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Μιχαήλ Νικόλαος Παναγιώτης Χρήστος".split(),
}
# Titles by gender.
TITLES = {"f": "Mrs Ms Miss Frau Mme Madame Mlle Sra Señora Г-жа Κα".split(), "m": "Mr Herr M Monsieur Sr Señor Г-н Κος".split(), "": "Dr Prof".split()}
# Letters that trade places, by script and kind.
LETTERS = ["aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóú", "àèìòù", "âêîôû", "äëïöü", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ", "αεηιου", "βγδζθκλμνξπρστφχψ", "άέήίόύ"]
DIGITS, HEX = "0123456789", "0123456789abcdef"
KIND = {c: k for k, x in enumerate(LETTERS) for c in x}
GENDER_OF = {n: key for key, names in FIRST_NAMES.items() for n in names}

_name = r"[^\W\d_]+(?:[-'’][^\W\d_]+)*"
_capitals = "".join(chr(c) for c in range(0x110000) if chr(c).isupper() and chr(c).isalpha())
#: A name in upper or title case: a lower-case word behind a surname is running text, not a further name.
_proper = rf"(?=[{_capitals}]){_name}"
_first = "|".join(sorted(map(re.escape, GENDER_OF), key=len, reverse=True))
_title = "|".join(re.escape(t) for v in TITLES.values() for t in sorted(v, key=len, reverse=True))
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "key": r"(?i:(?<=token = \")|(?<=key = \")|(?<=secret = \")|(?<=password = \")|(?<=token=)|(?<=api_key=))[A-Za-z0-9_/+-]{16,}",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])",
    "card": r"(?<![\w.-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?!\w|-\w|\.\d)|(?<![\w.-])3[47]\d{13}(?!\w)",
    "person": rf"\b(?:(?P<title>{_title})\.? +(?P<given>{_proper} +)?(?P<family>{_proper})|(?P<first>{_first}) +(?P<last>{_proper}))\b",
}
ANY = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items() if k not in ("card", "person")) + "|(?P<card>" + PATTERNS["card"].replace(r"\1", r"(?P=gap)").replace("([ -]?)", "(?P<gap>[ -]?)") + ")|(?P<person>" + PATTERNS["person"] + ")")
#: A text without any of these holds no entity: a digit, an at sign or a name's beginning.
HINT = re.compile(rf"[0-9@]|(?<![\w])(?:{_first}|{_title})\.? |(?i:token|key|secret|password)")


def valid_card(text: str) -> bool:
    """Whether the last digit is the check digit of a card number."""
    digits = [int(c) for c in reversed(text) if c in DIGITS]
    return (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def listed(name: str) -> str | None:
    """The first name of the lists that this is, as it is there or all in capitals."""
    if name in GENDER_OF:
        return name
    low = name.capitalize()
    return low if low in GENDER_OF and low.upper() == name else None


class Surrogates:
    """Keyed, type-consistent permutations."""

    def __init__(self, key: bytes):
        self.key = key
        self.cycle = functools.lru_cache(64)(self._cycle)
        self.digits = functools.lru_cache(1 << 15)(self._digits)
        self.of = functools.lru_cache(1 << 15)(self._of)

    def _draw(self, *parts) -> int:
        return int.from_bytes(hmac.new(self.key, repr(parts).encode(), hashlib.sha256).digest(), "big")

    def _cycle(self, size: int, tweak: str) -> list[int]:
        """Where each of `size` values goes in one keyed cycle through all (Sattolo's shuffle)."""
        to, rng = list(range(size)), random.Random(self._draw("cycle", size, tweak))
        for i in range(size - 1, 0, -1):
            j = rng.randrange(i)
            to[i], to[j] = to[j], to[i]
        return to

    def permuted(self, value: int, size: int, tweak: str) -> int:
        if size <= 1:
            return value
        if size <= SMALL:
            return self.cycle(size, tweak)[value]
        low = 1 << ((size - 1).bit_length() + 1) // 2
        high = -(-size // low)
        while True:  # walks on until the value is inside again
            a, b = divmod(value, low)
            for k in range(6):
                if k % 2:
                    b = (b + self._draw(tweak, k, a)) % low
                else:
                    a = (a + self._draw(tweak, k, b)) % high
            value = a * low + b
            if value < size:
                return value

    def _digits(self, text: str, alphabet: str, tweak: str) -> str:
        """A string over the alphabet, of the same length."""
        base, value = len(alphabet), 0
        for c in text:
            value = value * base + alphabet.index(c)
        value, out = self.permuted(value, base ** len(text), f"{tweak}/{alphabet}/{len(text)}"), []
        for _ in text:
            value, c = divmod(value, base)
            out.append(alphabet[c])
        return "".join(reversed(out))

    def shaped(self, text: str, tweak: str) -> str:
        """Letters and digits change within their kind; case, script and all other characters stay."""
        groups: dict[str, list[int]] = {}
        low = text.lower()
        if len(low) != len(text):
            low = text
        for i, c in enumerate(low):
            alphabet = DIGITS if c in DIGITS else LETTERS[KIND[c]] if c in KIND else None
            if alphabet:
                groups.setdefault(alphabet, []).append(i)
        shape = "".join("d" if c in DIGITS else chr(65 + KIND[c]) if c in KIND else c for c in low)
        out = list(text)
        for alphabet, at in groups.items():
            for i, c in zip(at, self.digits("".join(low[i] for i in at), alphabet, f"{tweak}/{shape}")):
                out[i] = c.upper() if text[i] != low[i] else c
        return "".join(out)

    def first(self, name: str) -> str:
        if (known := listed(name)) is None:
            new = self.shaped(name, "given")
            while listed(new):  # walks on, so that no listed name's surrogate is met
                new = self.shaped(new, "given")
            return new
        names = FIRST_NAMES[GENDER_OF[known]]
        new = names[self.permuted(names.index(known), len(names), f"first/{GENDER_OF[known]}")]
        return new if name == known else new.upper()

    def family(self, name: str) -> str:
        return self.shaped(name, "family")

    def card(self, text: str) -> str:
        """All digits but the last change; that is the check digit."""
        digits = [int(c) for c in text if c in DIGITS]
        body = self.digits("".join(map(str, digits[:-1])), DIGITS, "card")
        new = iter(body + next(c for c in DIGITS if valid_card(body + c)))
        return "".join(next(new) if c in DIGITS else c for c in text)

    def address(self, text: str) -> str:
        """Private, loopback and other reserved networks keep their first octets, as many as their kind has."""
        value = int(ipaddress.IPv4Address(text))
        for net in ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16"):
            own = ipaddress.ip_network(net)
            if value & int(own.netmask) == int(own.network_address):
                base, size = int(own.network_address), own.num_addresses
                return str(ipaddress.IPv4Address(base + self.permuted(value - base, size, f"ip/{net}")))
        while True:
            value = self.permuted(value, 1 << 32, "ip")
            new = ipaddress.IPv4Address(value)
            if not any(new in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "127.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "169.254.0.0/16")):
                return str(new)

    def _of(self, kind: str, text: str) -> str:
        if kind == "email":
            local, _, domain = text.rpartition("@")
            head, _, tld = domain.rpartition(".")
            low = self.shaped(local.lower(), "local")
            return f"{''.join(c.upper() if o.isupper() else c for c, o in zip(low, local))}@{self.shaped(head, 'domain')}.{tld}"
        if kind == "ip":
            return self.address(text)
        if kind == "card":
            return self.card(text)
        if kind == "phone":
            lead = re.match(r"\+\d{1,3}(?=[ .(-])", text)
            keep = lead.end() if lead else 0
            digits = "".join(c for c in text[keep:] if c in DIGITS)
            new = iter(self.digits(digits, DIGITS, f"phone/{text[:keep]}"))
            return text[:keep] + "".join(next(new) if c in DIGITS else c for c in text[keep:])
        if kind == "key" and all(c in HEX for c in text.lower()) and text in (text.lower(), text.upper()):
            new = self.digits(text.lower(), HEX, "key")
            return new.upper() if text.isupper() else new
        if kind == "iban":
            return text[:2] + self.shaped(text[2:], "iban")
        return self.shaped(text, kind)

    def entities(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, surrogate) in text order; names are of kind given or family."""
        if not HINT.search(text):
            return []
        found, people = [], []
        families: set[str] = set()
        for m in ANY.finditer(text):
            kind = next(k for k in PATTERNS if m[k] is not None)
            if kind == "person":
                people.append(m)
                last = m["family"] or m["last"]
                if m["given"] or m["first"] or listed(last) is None:
                    families.add(last)
            elif kind != "card" or valid_card(m[kind]):
                found.append((m.start(), m.end(), kind, self.of(kind, m[kind])))
        for m in people:
            last = m["family"] or m["last"]
            given = (m["given"] or "").strip() or m["first"]
            if given:
                at = m.start("given") if m["given"] else m.start("first")
                found.append((at, at + len(given), "given", self.first(given)))
            at = m.start("family") if m["family"] else m.start("last")
            if last in families:
                found.append((at, at + len(last), "family", self.family(last)))
            else:
                found.append((at, at + len(last), "given", self.first(last)))
        if families:
            taken = [(a, b) for a, b, *_ in found]
            for m in re.finditer(r"\b(?:" + "|".join(map(re.escape, sorted(families, key=len, reverse=True))) + r")\b", text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    found.append((m.start(), m.end(), "family", self.family(m[0])))
        return sorted(found)

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with surrogates, and (kind, start and length in the new text, surrogate)."""
        out, spans, at, size = [], [], 0, 0
        for a, b, kind, new in self.entities(text):
            out += [text[at:a], new]
            size += a - at
            spans.append(("person" if kind in ("given", "family") else kind, size, len(new), new))
            size, at = size + len(new), b
        return "".join(out) + text[at:], spans


def surrogates(docs: DataFrame, key: str = "replace this key") -> DataFrame:
    """doc_id, text with surrogates, n_entities, and the entities (kind, start, length, surrogate)."""
    secret = key.encode()

    def run(batches):
        own = Surrogates(secret)
        for b in batches:
            texts, spans = [], []
            for t in b.column(1).to_pylist():
                new, found = own.rewrite(t) if t else (t, [])
                texts.append(new)
                spans.append([dict(zip(("kind", "start", "length", "surrogate"), x)) for x in found])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("surrogate", pa.string())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kind)], names=["doc_id", "text", "n_entities", "entities"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string, n_entities long, entities array<struct<kind:string,start:int,length:int,surrogate:string>>")
    return out


def entity_map(docs: DataFrame, key: str = "replace this key") -> DataFrame:
    """Distinct (kind, digest of the original, surrogate) over all documents; names are of kind given or family."""
    secret = key.encode()

    def run(batches):
        own, seen = Surrogates(secret), set()
        for b in batches:
            out = []
            for t in b.column(0).to_pylist():
                for start, end, kind, new in own.entities(t or ""):
                    x = t[start:end]
                    if kind == "email":
                        x, new = x.lower(), new.lower()
                    pair = (kind, hmac.new(secret, f"{kind}:{x}".encode(), hashlib.sha256).hexdigest(), new)
                    if pair not in seen:
                        seen.add(pair)
                        out.append(pair)
            if len(seen) > SMALL:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in range(3)], names=["kind", "digest", "surrogate"])

    return docs.select("text").mapInArrow(run, "kind string, digest string, surrogate string").distinct()


def collisions(docs: DataFrame, key: str = "replace this key") -> DataFrame:
    """Surrogates that stand for more than one original of their kind."""
    return entity_map(docs, key).groupBy("kind", "surrogate").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(docs: DataFrame, key: str = "replace this key") -> DataFrame:
    """`surrogates`, with the number of collisions over all documents in every row."""
    found = collisions(docs, key).agg(F.count(F.lit(1)).alias("n_collisions"))
    return surrogates(docs, key).crossJoin(F.broadcast(found))
