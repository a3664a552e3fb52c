"""Personal data: fixed patterns plus a linear-chain conditional random field over word shapes.

The patterns give the base spans. The field adds names, addresses, identity numbers and secrets: it
is trained on a small labelled table (token, label) by full-batch gradient steps on the exact
likelihood, and decoded by Viterbi in numpy batches. A token whose emission favours "other" by more
than any transition can win back is "other" on the best path whatever its neighbours are; texts fall
apart at such tokens, and only what lies between them is decoded, with the same result.
"""

from __future__ import annotations

import bisect
import itertools
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reprolens.llm.common import as_bytes, batches, plain, trim, word_spans
from reprolens.sources.staging import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("other", "name", "address", "number", "secret")
MEMO = 20_000  # words whose scores a process keeps
MOST_LABELLED = 50_000  # rows of a labelled table, at most
_DOMAIN = re.compile(rb"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = np.zeros(256, dtype=bool)
_LOCAL[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")] = True
_IP = re.compile(rb"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(rb"[0-9]")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = (c - 48) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(raw: bytes) -> Iterator[tuple[int, int]]:
    """Matches of the address pattern, found from each @: its local part is the run of local characters before it."""
    done, at = 0, raw.find(b"@")
    while at >= 0:
        start = at
        while start > done and _LOCAL[raw[start - 1]]:
            start -= 1
        if start < at and (m := _DOMAIN.match(raw, at)):
            yield start, m.end()
            done = m.end()
            at = raw.find(b"@", done)
        else:
            at = raw.find(b"@", at + 1)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, end, kind) in bytes, in the order of start and kind."""
    out = []
    if b"@" in raw:
        out += [(a, b, 0) for a, b in _emails(raw)]
    if _DIGIT.search(raw):
        for m in _IP.finditer(raw):
            if all(len(p := g.lstrip(b"0")) <= 3 and int(p or b"0") <= 255 for g in m.groups()):
                out.append((m.start(), m.end(), 1))
        for m in _CARD.finditer(raw):
            if 12 <= m.end() - m.start() <= 37 and 12 <= len(d := m[0].replace(b" ", b"").replace(b"-", b"")) <= 19 and luhn(d):
                out.append((m.start(), m.end(), 2))
        if b"+" in raw:
            for m in _PHONE.finditer(raw):
                if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                    out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2], x[1]))


# --- the labelled table -------------------------------------------------------------------------

#: Fixed values from which the labelled table is made.
GIVEN = "Anna Marc Lena Jonas Maria Paul Elena Hugo Nina Omar Clara David Ines Felix Rosa Ivan Julia Peter Sofia Karl Aisha Bruno Chen Dimitri Esther Fatima Goran Hannah Igor Jana".split()
FAMILY = "Keller Martin Novak Silva Meyer Rossi Dubois Garcia Schmidt Moreau Lopez Weber Costa Fischer Blanc Torres Wagner Petit Ruiz Brandt Okafor Lindqvist Haddad Tanaka Kowalski Murphy Ivanova Nguyen Baker Ortega".split()
STREETS = "Oak Elm Mill Church Station Garden Hill Lake Park River Maple Victoria Castle Market Bridge".split()
ROADS = "Street Avenue Road Lane Boulevard Drive Court Square".split()
ROADS_BEFORE = "rue calle via avenida".split()
TITLES = "Mr. Mrs. Ms. Dr. Prof. Herr Frau Señor Señora Madame Monsieur".split()
ROLES = "President Chairman Chairwoman Speaker Secretary Minister Ambassador Director Mayor Judge Chancellor Senator".split()
NAME_CUES = "name contact person signed regards sincerely attn patient customer employee recipient author heiße appelle llamo nombre nom dear".split()
SECRET_CUES = "token password secret api_key apikey passwd access_token auth_token client_secret credentials pwd passphrase".split()
NUMBER_CUES = "ssn passport iban licence_no tax_id".split()
HASH_CUES = "commit sha256 sha1 md5 checksum digest revision build".split()
OTHER_CUES = "version chapter page section figure support sales team department office".split()
KEY_PREFIXES = ("sk-", "ghp_", "gho_", "github_pat_", "AKIA", "ASIA", "xoxb-", "xoxp-", "AIza", "glpat-", "npm_", "pk_live_", "sk_live_")
SYLLABLES = "the er on an in th re at en es or ti ing ion ou ha le de la eau que un mente ción os as ra ung en ver sch keit ich der die".split()
#: Each cue with the group it belongs to.
GROUPS = {
    w.lower().strip("."): group
    for group, words in (("title", TITLES), ("role", ROLES), ("road", ROADS), ("road_before", ROADS_BEFORE), ("name", NAME_CUES), ("secret", SECRET_CUES), ("number", NUMBER_CUES), ("hash", HASH_CUES), ("else", OTHER_CUES))
    for w in words
}
CUES = frozenset(GROUPS)
_LETTERS, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled_rows(seed: int = 7, sentences: int = 1800) -> list[tuple[int, int, str, str]]:
    """(sentence, position, token, label): templates for each label among invented prose, and much the same words where they name nobody."""
    r = random.Random(seed)
    some = lambda letters, n: "".join(r.choice(letters) for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4)))
        return (w.capitalize() if r.random() < 0.15 else w) + r.choice(["", "", "", "", "", ",", "."])

    def prose(n: int) -> list[tuple[str, str]]:
        return [(word(), "other") for _ in range(n)]

    def tagged(text: str, label: str = "other") -> list[tuple[str, str]]:
        return [(w, label) for w in text.split()]

    end = lambda: r.choice(["", "", ",", "."])
    capital = lambda: "".join(r.choice(SYLLABLES) for _ in range(2)).capitalize()
    plain_word = lambda: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))

    def person() -> str:
        given, family = r.choice([r.choice(GIVEN), capital()]), r.choice([r.choice(FAMILY), capital()])
        return r.choice([f"{given} {family}", f"{given} {family}", f"{given} {r.choice(_LETTERS).upper()}. {family}"])

    def name() -> list[tuple[str, str]]:
        cue = r.choice(["my name is", "his name is", "Name:", "name:", "contact person:", "signed by", "Signed,", "Regards,", "Kind regards,", "Sincerely,", "Please contact", "please contact", "contact", "Contact:", "attn:", "Patient:", "patient", "Customer:", "customer", "employee", "Employee:", "recipient:", "author:", "mein Name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "mon nom est", "Dear"])
        if r.random() < 0.35:
            return [(r.choice(TITLES), "other"), *tagged(r.choice([person(), r.choice([r.choice(FAMILY), capital()])]) + end(), "name")]
        return [*tagged(cue), *tagged(person() + end(), "name")]

    def nobody() -> list[tuple[str, str]]:
        """Cues of names without a name, and capitals without a cue."""
        return tagged(r.choice([
            f"{r.choice(TITLES[:6])} {r.choice(ROLES)}{end()} {plain_word()}", f"Madame {r.choice(ROLES)}", f"the {r.choice(ROLES)} {plain_word()}", f"my name is {plain_word()}", f"name: {plain_word()} {plain_word()}", f"Regards, {plain_word()}",
            f"please contact {r.choice(['Support', 'Sales', 'support', 'the office', 'our team', 'your department'])}{end()}", f"signed {plain_word()} {plain_word()}", f"{capital()} {capital()} {plain_word()}", f"{plain_word()}. {capital()} {plain_word()}",
            f"{capital()}. {capital()} {plain_word()}. {capital()}. {plain_word()}", " ".join([capital() + end()] * r.randint(3, 12)), f"Dear {plain_word()}", f"the customer {plain_word()}", f"author {plain_word()}", f"{plain_word()}. {r.choice(_LETTERS).upper()}. {capital()} {plain_word()}", f"{r.choice(_LETTERS).upper()}. {capital()}. {plain_word()}", f"{plain_word()} the {some(_LETTERS, 3).upper()} {capital()} {capital()} {capital()}", f"{capital()} under the {some(_LETTERS, 3).upper()} {capital()}.", f"{plain_word()} | {capital()} | {plain_word()}",
        ]))

    def address() -> list[tuple[str, str]]:
        n, street = r.randint(1, r.choice([99, 999, 9999, 20000])), r.choice([r.choice(STREETS), capital()])
        return tagged(r.choice([f"{n} {street} {r.choice(ROADS)}", f"{n} {street} {r.choice(ROADS)}", f"{n} {r.choice(['North', 'Old', 'New', capital()])} {street} {r.choice(ROADS)}", f"{n} {r.choice(ROADS_BEFORE)} {street}", f"{r.choice(ROADS_BEFORE).capitalize()} {street} {n}"]) + end(), "address")

    def nowhere() -> list[tuple[str, str]]:
        n = r.randint(1, 2030)
        return tagged(r.choice([f"{n} {plain_word()} {plain_word()}", f"{r.choice(['chapter', 'Chapter', 'page', 'version', 'Section'])} {r.randint(1, 99)}{end()} {capital()} {plain_word()}", f"{n} {capital()} {plain_word()}", f"{capital()} {r.choice(ROADS)} {plain_word()}", f"{capital()} License, version {r.randint(1, 9)}.", f"Version {r.randint(1, 9)}.{r.randint(0, 9)}", f"{n}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{plain_word()} {n},{r.randint(100, 999)} {plain_word()}", " ".join(str(r.randint(0, 99)) for _ in range(r.randint(2, 14))), " ".join([str(n)] * r.randint(2, 14)), f"{n} {plain_word()} {r.choice(ROADS).lower()} {plain_word()}"]))

    def number() -> list[tuple[str, str]]:
        kind = r.randrange(4)
        if kind == 0:
            cue, value = r.choice(["SSN:", "ssn", "SSN", "social security number"]), f"{some(_DIGITS, 3)}-{some(_DIGITS, 2)}-{some(_DIGITS, 4)}"
        elif kind == 1:
            cue, value = r.choice(["passport", "Passport", "Passport:", "passport no."]), r.choice(_LETTERS).upper() + some(_DIGITS, 8)
        elif kind == 2:
            cue, value = r.choice(["IBAN", "IBAN:", "iban"]), r.choice(["DE", "FR", "ES", "IT", "NL"]) + some(_DIGITS, 20)
        else:
            cue, value = r.choice(["", "number"]), f"{some(_DIGITS, 3)}-{some(_DIGITS, 2)}-{some(_DIGITS, 4)}"
        return [*tagged(cue), (value + end(), "number")]

    def no_number() -> list[tuple[str, str]]:
        return tagged(r.choice([f"+{r.randint(1, 99)} {some(_DIGITS, 2)} {some(_DIGITS, 7)} {plain_word()}", f"({some(_DIGITS, 3)}) {some(_DIGITS, 3)}-{some(_DIGITS, 4)}", some(_DIGITS, 16), " ".join(some(_DIGITS, 4) for _ in range(4)), f"{plain_word()}@{plain_word()}.org {r.randint(1, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}.{r.randint(0, 255)}", f"the passport {plain_word()}", f"{some(_DIGITS, 1)}-{some(_DIGITS, 2)} {plain_word()}", f"{some(_DIGITS, 3)}-{some(_DIGITS, 4)}"]))

    def secret() -> list[tuple[str, str]]:
        mixed = _LETTERS + _LETTERS.upper() + _DIGITS
        password = "".join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4))) + some(_DIGITS, r.randint(1, 4)) + "".join(r.choice(SYLLABLES) for _ in range(r.randint(0, 3))) + r.choice(["", "", "!", "#", "$"])
        value = r.choice([some("0123456789abcdef", r.choice([32, 40, 64])), some("0123456789abcdef", 40), r.choice(KEY_PREFIXES[:1]) + some(mixed, r.choice([24, 48])), "ghp_" + some(mixed, 36), "AKIA" + some(_LETTERS.upper() + _DIGITS, 16), r.choice(KEY_PREFIXES) + some(mixed, r.randint(16, 40)), some(mixed, r.randint(20, 44)), password, password])
        value = r.choice([f'"{value}"', value, value, f"'{value}'"])
        cue = r.choice(SECRET_CUES)
        cue = r.choice([cue, cue, cue.capitalize(), cue.upper()])
        form = r.randrange(6)
        if form == 0 and value.strip("'\"").startswith(KEY_PREFIXES):
            return [(value + end(), "secret")]
        if form == 1:
            return [(f"{cue}{r.choice('=:')}{value}", "secret")]
        return [*tagged(r.choice([f"{cue} =", f"{cue}:", f"{cue} is", f"{cue} is:"])), (value + end(), "secret")]

    def no_secret() -> list[tuple[str, str]]:
        return tagged(r.choice([
            f"{r.choice(HASH_CUES)} {some('0123456789abcdef', r.choice([7, 32, 40, 64]))}", f"{r.choice(HASH_CUES)}: {some('0123456789abcdef', 40)}", f"the {r.choice(SECRET_CUES)} is {plain_word()}", f"{r.choice(SECRET_CUES)}: {plain_word()}", f"{r.choice(SECRET_CUES)} {plain_word()}{end()}", f"a {r.choice(SECRET_CUES)} of {r.randint(8, 64)} {plain_word()}",
            " ".join(r.choice([plain_word(), capital()]) + r.choice(["", ",", "."]) + r.choice("!@#$%^&*~") * r.randint(1, 4) for _ in range(r.randint(2, 6))), f"{plain_word().upper()}!! {plain_word().upper()},!! {plain_word().upper()}.!!", f"{plain_word()}{r.randint(1, 9)} {plain_word()}-{r.randint(1, 99)}", f"https://{plain_word()}.org/{plain_word()}/{r.randint(1, 999)}", f"http://www.{plain_word()}{plain_word()}.com/{plain_word()}?id={r.randint(1, 9999)}", f"{plain_word()}_{plain_word()}.py {plain_word()}()", f"<{plain_word()}> </{plain_word()}>",
        ]))

    makers = (name, nobody, address, nowhere, number, no_number, secret, no_secret, name, secret, nobody, lambda: prose(5))
    made = [prose(r.randint(0, 5)) + makers[i % len(makers)]() + prose(r.randint(0, 5)) for i in range(sentences)]
    return [(i, j, t, label) for i, s in enumerate(made) for j, (t, label) in enumerate(s)]


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "sentence long, position int, token string, label string")


# --- features, training, decoding ---------------------------------------------------------------

_STRIP = ".,;:!?\"'()[]"


#: Places, from a token, of the tokens whose features speak for its label.
OFFSETS = (0, -1, 1, -2, 2, -3)


def shape(word: str) -> str:
    """A for capitals, a for other letters, 0 for digits; other characters as they are."""
    return "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in word)


def entropy(word: str) -> float:
    """Bits for each character."""
    n = len(word)
    return -sum(c / n * math.log2(c / n) for c in Counter(word).values()) if n else 0.0


def word_features(word: str, cues: frozenset[str]) -> list[str]:
    """Features of the whole word; those of words of letters alone depend on their shape and on the cues only."""
    core = word.strip(_STRIP)
    form = shape(core)
    runs = re.sub(r"(.)\1+", r"\1", form)
    out = ["bias", "short:" + runs if len(runs) <= 5 else "long"]
    if (low := core.lower()) in cues:
        out += ["cue:" + low, "group:" + GROUPS.get(low, "else")]
    if word[-1:] in ":=":
        out.append("end:" + word[-1:])
    if runs in ("", "a", "A", "Aa"):
        return out
    n = len(core)
    out.append(f"length:{sum(n >= least for least in (4, 8, 13, 20, 32))}")
    if "0" in form and n <= 24:
        out.append("shape:" + re.sub(r"(.)\1{4,}", r"\1\1\1\1+", form))
    classes = {c if c in "Aa0" else "-" for c in form}
    out += ["has:" + c for c in sorted(classes)]
    if "0" in classes and classes & {"A", "a"}:
        out.append("mixed" if n < 8 else "mixed:long")
    if n >= 20 and re.fullmatch("[0-9a-f]+", core) and re.search("[0-9]", core) and re.search("[a-f]", core):
        out.append("hex")
    if n >= 8:
        out.append(f"entropy:{sum(entropy(core) >= least for least in (2.5, 3.2, 3.8))}")
    if core.startswith(KEY_PREFIXES):
        out.append("key")
    if "://" in core:
        out.append("url")
    left = re.split("[:=]", core, maxsplit=1)
    if len(left) == 2 and left[1] and left[0].lower() in cues:
        out += ["assigned:" + left[0].lower(), "assigned"]
    return out


@dataclass
class Field:
    """Weights: for the features of the tokens at each of OFFSETS; transitions between labels."""

    cues: frozenset[str]
    index: dict[str, int]
    emission: np.ndarray  # offsets x features x labels
    transition: np.ndarray  # labels x labels
    start: np.ndarray
    end: np.ndarray

    memo: dict[str, np.ndarray] | None = None  # scores of words met before, at most MEMO of them

    def scores(self, words: list[str]) -> np.ndarray:
        """offsets x words x labels; words without a known feature have the bias alone."""
        if self.memo is None or len(self.memo) > MEMO:
            self.memo = {}
        for w in words:
            if w not in self.memo:
                self.memo[w] = self.emission[:, [k for f in word_features(w, self.cues) if (k := self.index.get(f)) is not None]].sum(axis=1)
        return np.stack([self.memo[w] for w in words], axis=1)

    def emissions(self, table: list[str], code: np.ndarray, line: np.ndarray) -> np.ndarray:
        """words x labels, of words given by their number in a table and their line: what tokens of the same line at each offset say."""
        scores = self.scores(table)
        e = scores[0][code]
        for role, k in enumerate(OFFSETS):
            if k < 0:
                e[-k:] += scores[role][code[:k]] * (line[-k:] == line[:k])[:, None]
            elif k > 0:
                e[:-k] += scores[role][code[k:]] * (line[:-k] == line[k:])[:, None]
        return e

    def gains(self) -> np.ndarray:
        """For each label but "other": the most that any path can win by it at one token, over "other", by transitions."""
        k = len(LABELS)
        t = np.zeros((k + 1, k + 1))  # the outside of a line as one more label
        t[:k, :k], t[k, :k], t[:k, k] = self.transition, self.start, self.end
        into, out = t[:, 1:k] - t[:, :1], t[1:k, :] - t[:1, :]
        return into.max(axis=0) + out.max(axis=1) + 1e-9


def train(rows: Iterable[tuple[int, int, str, str]], steps: int = 160, rate: float = 0.5, ridge: float = 0.003, stiff: float = 3.0) -> Field:
    """Maximum likelihood with a ridge (``stiff`` for transitions), by AdaGrad on the exact gradient (forward-backward over padded sentences)."""
    sentences: dict[int, list[tuple[int, str, str]]] = {}
    for s, p, t, label in sorted(rows):
        sentences.setdefault(s, []).append((p, t, label))
    texts = [[(t, LABELS.index(label)) for _, t, label in x] for x in sentences.values()]
    cues = CUES
    index: dict[str, int] = {}
    features = [[[index.setdefault(f, len(index)) for f in word_features(t, cues)] for t, _ in x] for x in texts]
    n, longest, k, m = len(texts), max(map(len, texts)), len(LABELS), len(index)
    gold = np.zeros((n, longest), dtype=np.int64)
    mask = np.zeros((n, longest), dtype=bool)
    rows_, cols, roles = [], [], []
    for i, x in enumerate(texts):
        for j, (_, label) in enumerate(x):
            gold[i, j], mask[i, j] = label, True
            for role, at in enumerate(j + k for k in OFFSETS):
                if 0 <= at < len(x):
                    for f in features[i][at]:
                        rows_.append(i * longest + j)
                        cols.append(f)
                        roles.append(role)
    cell, feature = np.array(rows_), np.array(cols) + m * np.array(roles)
    # Both sums run over neighbours: cells come in order, features once sorted.
    by_feature = np.argsort(feature, kind="stable")
    of_cell, of_feature = (np.flatnonzero(np.diff(x, prepend=-1)) for x in (cell, feature[by_feature]))
    w = np.zeros((len(OFFSETS) * m, k))
    tr, st, en = np.zeros((k, k)), np.zeros(k), np.zeros(k)
    grads = [np.full_like(p, 1e-8) for p in (w, tr, st, en)]
    one = np.eye(k)
    last = mask.sum(axis=1) - 1
    who = np.arange(n)
    pair = mask[:, 1:]
    observed = np.zeros((n * longest, k))
    observed[mask.ravel()] = one[gold[mask]]
    seen_tr = np.zeros((k, k))
    np.add.at(seen_tr, (gold[:, :-1][pair], gold[:, 1:][pair]), 1)

    def lse(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))

    for _ in range(steps):
        e = np.zeros((n * longest, k))
        e[cell[of_cell]] = np.add.reduceat(w[feature], of_cell)
        e = e.reshape(n, longest, k)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0] + st
        for j in range(1, longest):
            a[:, j] = np.where(mask[:, j, None], e[:, j] + lse(a[:, j - 1, :, None] + tr, 1), a[:, j - 1])
        b[who, last] = en
        for j in range(longest - 2, -1, -1):
            step = lse(tr + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2)
            b[:, j] = np.where((j < last)[:, None], step, b[:, j])
        z = lse(a[who, last] + en, 1)
        p = np.exp(a + b - z[:, None, None]) * mask[:, :, None]
        xi = np.exp(a[:, :-1, :, None] + tr + (e[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        g = np.zeros_like(w)
        g[feature[by_feature[of_feature]]] = np.add.reduceat((observed - p.reshape(-1, k))[cell[by_feature]], of_feature)
        gt, gs, ge = seen_tr - xi.sum(axis=(0, 1)), one[gold[:, 0]].sum(0) - p[:, 0].sum(0), one[gold[who, last]].sum(0) - p[who, last].sum(0)
        for q, x, h, pull in zip((w, tr, st, en), (g, gt, gs, ge), grads, (ridge, stiff, stiff, stiff), strict=True):
            x = x - pull * q
            h += x * x
            q += rate * x / np.sqrt(h)
    return Field(cues, index, w.reshape(len(OFFSETS), m, k), tr, st, en)


def viterbi(emissions: np.ndarray, lengths: np.ndarray, field: Field, before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Best labels of padded segments at once. before, after: whether a token "other" stands next to the segment (else a line ends)."""
    n, longest, k = emissions.shape
    e = np.ascontiguousarray(emissions.transpose(1, 2, 0))  # steps x labels x segments
    back = np.zeros((longest, k, n), dtype=np.int8)
    score = e[0] + np.where(before[None], field.transition[0][:, None], field.start[:, None])
    for j in range(1, longest):
        best = score[0][None] + field.transition[0][:, None]
        for a in range(1, k):
            other = score[a][None] + field.transition[a][:, None]
            better = other > best
            back[j][better] = a
            np.maximum(best, other, out=best)
        best += e[j]
        score = np.where((j < lengths)[None], best, score)
    score = score + np.where(after[None], field.transition[:, 0][:, None], field.end[:, None])
    out = np.zeros((n, longest), dtype=np.int8)
    label = score.argmax(axis=0)
    who = np.arange(n)
    for j in range(longest - 1, -1, -1):
        here = j < lengths
        out[here, j] = label[here]
        if j:
            label = np.where(here, back[j, label, who], label)
    return out


_LETTER = np.zeros(256, dtype=bool)  # bytes of lower-case letters of Latin-1, in UTF-8
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz")] = True
_LETTER[[0x9F, *range(0xA0, 0xC0), 0xC3]] = True
_LETTER[0xB7] = False
_NEWLINE = 10


def field_spans(texts: list[bytes], field: Field, cells: int = 1 << 20) -> list[list[tuple[int, int, str]]]:
    """For each text the spans (byte begin, byte end, label) that the field labels, line by line."""
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    buffer, starts, ends, offsets = word_spans(texts)
    if not len(starts):
        return out
    # Most words are lower-case or capitalised and no cue; all of either kind have the same features.
    code = _kinds(buffer, starts, ends)
    special = np.concatenate([np.flatnonzero(code == 2), _cue_words(buffer, starts, ends, code, field.cues)])
    whole = buffer.tobytes()
    table: dict[str, int] = {"aa": 0, "Aa": 1}
    code[special] = [table.setdefault(whole[a:b].decode(), len(table)) for a, b in zip(starts[special].tolist(), ends[special].tolist(), strict=True)]
    # A line ends between two words if a line feed lies between them.
    feeds = np.cumsum(buffer == _NEWLINE)
    first = np.ones(len(starts), dtype=bool)
    first[1:] = feeds[starts[1:]] != feeds[starts[:-1]]
    last = np.concatenate([first[1:], [True]])
    e = field.emissions(list(table), code, np.cumsum(first))
    sure = (e[:, :1] - e[:, 1:] > field.gains()).all(axis=1)
    todo = np.flatnonzero(~sure)
    if not len(todo):
        return out
    # Segments: neighbouring unsure words of one line.
    cut = np.flatnonzero((np.diff(todo) != 1) | first[todo[1:]]) + 1
    begin, stop = np.concatenate([[0], cut]), np.concatenate([cut, [len(todo)]])
    sizes = stop - begin
    labels = np.zeros(len(starts), dtype=np.int8)
    by_size = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(by_size):
        end = at + 1
        while end < len(by_size) and (end - at + 1) * sizes[by_size[end]] <= cells:
            end += 1
        pick = by_size[at:end]
        longest = int(sizes[pick].max())
        where = todo[begin[pick]][:, None] + np.minimum(np.arange(longest)[None], sizes[pick][:, None] - 1)
        got = viterbi(e[where], sizes[pick], field, ~first[todo[begin[pick]]], ~last[todo[stop[pick] - 1]])
        real = np.arange(longest)[None] < sizes[pick][:, None]
        labels[where[real]] = got[real]
        at = end
    hit = np.flatnonzero(labels)
    text_of = np.searchsorted(offsets, hit, side="right") - 1
    sizes_ = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    bases = np.concatenate([[0], np.cumsum(sizes_)])
    i = 0
    while i < len(hit):
        j = i
        while j + 1 < len(hit) and hit[j + 1] == hit[j] + 1 and labels[hit[j + 1]] == labels[hit[i]] and not first[hit[j + 1]]:
            j += 1
        a, b = int(starts[hit[i]]), int(ends[hit[j]])
        while a < b and chr(whole[a]) in _STRIP:
            a += 1
        while b > a and chr(whole[b - 1]) in _STRIP:
            b -= 1
        if a < b:
            base = int(bases[text_of[i]])
            out[text_of[i]].append((a - base, b - base, LABELS[labels[hit[i]]]))
        i = j + 1
    return out


def _kinds(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """0: lower-case letters; 1: a capital and then lower-case letters (either may end in a comma or full stop); 2: anything else."""
    odd = np.concatenate([[0], np.cumsum(~_LETTER[buffer])])
    tail = _core_end(buffer, starts, ends)
    lower = odd[tail] == odd[starts]
    wide = buffer[starts] == 0xC3
    second = buffer[np.minimum(starts + 1, len(buffer) - 1)]
    capital = np.where(wide, (second >= 0x80) & (second <= 0x9E) & (second != 0x97), (buffer[starts] >= 65) & (buffer[starts] <= 90))
    body = starts + 1 + wide
    title = capital & (body < tail) & (odd[np.maximum(tail, body)] == odd[np.minimum(body, tail)])
    code = np.where(title, 1, np.where(lower, 0, 2)).astype(np.int64)
    code[tail <= starts] = 2
    return code


def _core_end(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.where((ends > starts + 1) & ((buffer[ends - 1] == 44) | (buffer[ends - 1] == 46)), ends - 1, ends)


def _cue_words(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, code: np.ndarray, cues: frozenset[str]) -> np.ndarray:
    """Words of the two common kinds that are cues, found by length, first and last byte, then compared."""
    tail = _core_end(buffer, starts, ends)
    head, foot = buffer[starts].astype(np.int64), buffer[np.maximum(tail - 1, starts)].astype(np.int64)
    head = np.where((head >= 65) & (head <= 90), head + 32, head)
    marks = np.zeros(1 << 16 | 1 << 14, dtype=bool)  # by length, first and last byte
    for c in cues:
        raw = c.encode()
        marks[min(len(raw), 63) << 10 | (raw[0] & 31) << 5 | raw[-1] & 31] = True
    maybe = np.flatnonzero((code < 2) & marks[np.minimum(tail - starts, 63) << 10 | (head & 31) << 5 | foot & 31])
    return np.array([i for i in maybe.tolist() if buffer[starts[i] : tail[i]].tobytes().decode().lower() in cues], dtype=np.int64)


FOUND = "doc_id long, base array<struct<start:long,end:long,kind:string>>, added array<struct<start:long,end:long,kind:string>>"
_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def _beside(extra: list[tuple[int, int, str]], base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """The spans of ``extra`` that overlap none of ``base``; both are in the order of their starts."""
    if not base or not extra:
        return extra
    starts = [a for a, _, _ in base]
    reach = list(itertools.accumulate((b for _, b, _ in base), max))
    return [x for x in extra if not (n := bisect.bisect_left(starts, x[1])) or reach[n - 1] <= x[0]]


def spans_of(texts: list[bytes], field: Field) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """For each text its base spans and the added ones that overlap none of them, in code points, by start and kind."""
    out = []
    for raw, extra in zip(texts, field_spans(texts, field), strict=True):
        base = [(a, b, KINDS[k]) for a, b, k in base_spans(raw)]
        extra = _beside(extra, base)
        if (base or extra) and not raw.isascii():
            at = sorted({p for a, b, _ in base + extra for p in (a, b)})
            point, done, before = {}, 0, 0
            for p in at:
                before += len(raw[done:p].decode())
                point[p] = before
                done = p
            base, extra = ([(point[a], point[b], k) for a, b, k in x] for x in (base, extra))
        out.append((base, extra))
    return out


def find(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, base and added spans for each row. Null and empty texts have none; repeated rows are alike; an empty table gives no rows."""
    field = trained(labelled) if labelled is not None else own_field(spark)
    small_batches(spark)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, limit=1 << 21):
            found = spans_of(as_bytes(b.column(1)), field)
            to = lambda x: [{"start": a, "end": e, "kind": k} for a, e, k in x]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([to(x) for x, _ in found], _SPAN), pa.array([to(x) for _, x in found], _SPAN)], names=["doc_id", "base", "added"])

    return plain(docs, "doc_id", "text").mapInArrow(run, FOUND)


def trained(labelled: DataFrame) -> Field:
    rows = [tuple(r) for r in labelled.select("sentence", "position", "token", "label").limit(MOST_LABELLED + 1).collect()]
    if len(rows) > MOST_LABELLED:
        raise ValueError(f"a labelled table has {MOST_LABELLED} rows at most")
    return train(rows)


_OWN: list[Field] = []


def own_field(spark: SparkSession) -> Field:
    """The field of the table that comes with this module, trained once for each process."""
    if not _OWN:
        _OWN.append(trained(labelled_table(spark)))
    return _OWN[0]


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: base spans by kind, their checksum, all spans, and how many the field added and there are in all."""
    found = find(spark, docs)
    count = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    order = F.array_sort(F.concat("base", "added"), lambda x, y: F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).when(_rank(x) != _rank(y), F.when(_rank(x) < _rank(y), -1).otherwise(1)).otherwise(0))
    return found.select("doc_id", *count, F.sha2(text(F.col("base")).cast("binary"), 256).alias("base_sha256"), text(order).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(order).cast("long").alias("n_spans"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def _rank(span):
    return F.array_position(F.array(*[F.lit(k) for k in (*KINDS, *LABELS[1:])]), span["kind"])


def redact(spark: SparkSession, docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` with every span replaced by its kind in brackets, and n_chars counted anew where it exists; all other columns stay."""
    field = trained(labelled) if labelled is not None else own_field(spark)
    names = docs.columns
    at = names.index("text")
    small_batches(spark)

    def run(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(frames, limit=1 << 20):
            texts = b.column(at).to_pylist()
            out = []
            for text, (base, extra) in zip(texts, spans_of([(t or "").encode() for t in texts], field), strict=True):
                merged: list[list] = []
                for a, e, k in sorted(base + extra):
                    if merged and a < merged[-1][1]:
                        merged[-1][1] = max(e, merged[-1][1])
                    else:
                        merged.append([a, e, k])
                if merged:
                    edges = [0, *(p for a, e, _ in merged for p in (a, e)), len(text)]
                    between = [text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)]
                    text = "".join(x for pair in zip(between, [*(f"[{k.upper()}]" for _, _, k in merged), ""], strict=True) for x in pair)
                out.append(text)
            columns = list(b.columns)
            columns[at] = pa.array(out, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)
        trim()

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else done

