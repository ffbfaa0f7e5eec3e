"""Personal data: high-recall generators, boosted trees over format and context, calibrated thresholds.

Fixed patterns (``base_spans``) find e-mail addresses, IP addresses, card and phone numbers; they
always count. Generators propose many more, overlapping spans. Boosted trees score a proposal from
its form and the characters around it; the kind's threshold decides.

No spans are labelled, so every document gives its own examples. Positive are the matches of the fixed
patterns and other spellings of them put in the same place. Negative is only what something independent
says no to (``evidence``: a failed checksum, an octet over 255, a date, a number inside a word, an order
or version number) and look-alikes put in the place of a match. Any other proposal is *unlabelled*: it may
well be personal data in a spelling the patterns do not know, so it teaches the trees nothing, however
many of its kind there are. The trees learn from a bounded number of examples per kind and label, drawn
by hash from four fifths of all documents. The thresholds come from the scores of the examples of every
document that gave the trees none, and from those of the unlabelled proposals (``thresholds_of``).
"""

from __future__ import annotations

import hashlib
import logging
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappush, heappushpop
from itertools import accumulate
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from codefindings.llm.boosting import Boosted, boost
from codefindings.llm.common import doc_id, documents, leading_bits, whole_text
from codefindings.llm.registry import query
from codefindings.llm.words import slices

LOG = logging.getLogger(__name__)
KINDS = ['email', 'ip', 'card', 'phone', 'secret', 'ssn']
#: Examples per kind and label that the trees learn from.
FIT_EXAMPLES = 2000
#: Documents whose hash leaves no rest are kept back from the trees.
FOLDS = 5
PRECISION = 0.98
#: Lower ends of the score bins: 0, then steps of 0.05 in log-odds.
BINS = np.concatenate([[0.0], 1.0 / (1.0 + np.exp(-np.arange(-600, 601) / 20))])
#: The draw keeps the lowest hashes of so many lots of tasks, then of fewer.
DRAW_STEPS = (4096, 64, 1)
#: Examples scored at a time.
SCORED_AT_ONCE = 4096

LOCAL = re.compile(r'[A-Za-z0-9._%+-]+\Z')
DOMAIN = re.compile(r'[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')
LOCAL_CHARACTERS = frozenset('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-')
DOTTED = re.compile(r'[0-9]+(?:\.[0-9]+)*')
DIGITS = re.compile(r'[0-9](?:[ -]?[0-9])+')
PHONE = re.compile(r'\+[0-9][ ().0-9-]+[0-9]')
DIGIT = re.compile(r'[0-9]')

#: Marks of spelled-out addresses, and what follows one; what stands before is walked back to, without a bound.
AT = re.compile(r' ?(?:\[at\]|\(at\)|\{at\}) ?| at ', re.I)
SPELLED_DOMAIN = re.compile(r'[A-Za-z0-9-]+(?: ?(?:\[dot\]|\(dot\)|\{dot\}|\.) ?[A-Za-z0-9-]+)+', re.I)
PLAIN_DOMAIN = re.compile(r'[A-Za-z0-9-]+(?:(?: dot |\.)[A-Za-z0-9-]+)+', re.I)

#: Other proposals: kind and pattern. The text must contain a digit.
PROPOSALS = [
    ('phone', re.compile(r'\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])')),
    ('phone', re.compile(r'(?<![0-9.+-])(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-]|\.[0-9])')),
    ('phone', re.compile(r'(?<![0-9+])[0-9]{7,12}(?![0-9])')),
    ('ip', re.compile(r'(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])')),
    ('ip', re.compile(r'(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])')),
    ('ip', re.compile(r'(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6})?(?![0-9A-Za-z:])')),
    ('card', re.compile(r'(?<![0-9])[0-9]{13,19}(?![0-9])')),
    ('card', re.compile(r'(?<![0-9-])[0-9]{4}(?:[ -][0-9]{4}){3}(?![0-9])')),
    ('ssn', re.compile(r'(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])')),
    ('secret', re.compile(r'(?<![A-Za-z0-9_-])[A-Za-z0-9_-]{20,}(?![A-Za-z0-9_-])')),
]
#: Places of the IPv6 patterns, which need colons.
GROUPED, COMPRESSED = 4, 5
#: Names of hexadecimal letters only: with :: between them they look like addresses.
WORDS = ['Add', 'Bad', 'cafe', 'dead', 'Dad', 'face', 'fade', 'Bee', 'add', 'De']
HINTS = [re.compile(p, re.I) for p in (
    r'phone|tel\b|tel[.:]|call|mobile|fax|cell', r'mail|contact|write', r'card|visa|credit|pay',
    r'\bip\b|host|server|addr|from', r'token|key|secret|passw|auth|api|cred', r'ssn|social|security',
    r'order|invoice|version|isbn|issue|page|build|ticket|item|sku|ref|\bid\b|no\.|#', r'date|year|time|on |since')]

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """The fixed patterns' matches that pass their tests, by kind, leftmost and without overlap within a kind.

    Written so that time is linear in the text, e.g. an e-mail address is looked for around each @.
    """
    found, last, at = [], 0, text.find('@')
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(('email', start, domain.end()))
            last = domain.end()
        else:
            last = max(last, at + 1)
        at = text.find('@', max(at + 1, last))
    if not DIGIT.search(text):
        return found
    for run in DOTTED.finditer(text):
        start, parts = run.start(), run.group().split('.')
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip('0')) <= 3 and int(p.lstrip('0') or 0) <= 255 for p in four):
                found.append(('ip', start, end))
            start = end + 1
    for run in DIGITS.finditer(text):
        digits = run.group().replace(' ', '').replace('-', '')
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(('card', run.start(), run.end()))
    for run in PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in run.group()) <= 15:
            found.append(('phone', run.start(), run.end()))
    return found


def proposals(text: str) -> list[Span]:
    """Overlapping spans of all generators; each needs what its pattern cannot do without."""
    digits = DIGIT.search(text) is not None
    low = text.lower()
    found: set[Span] = set()
    if any(mark in low for mark in ('[at]', '(at)', '{at}', ' at ')):
        found.update(spelled_addresses(text))
    gates = {GROUPED: digits and text.count(':') >= 4, COMPRESSED: '::' in text}
    for i, (kind, pattern) in enumerate(PROPOSALS):
        if gates.get(i, digits):
            found.update((kind, m.start(), m.end()) for m in pattern.finditer(text) if i != COMPRESSED or _compressed(m.group()))
    return sorted(found)


def spelled_addresses(text: str) -> Iterator[Span]:
    """E-mail addresses with a spelled-out @, of any length: one walks outward from each mark."""
    for mark in AT.finditer(text):
        start = mark.start()
        while start and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = (PLAIN_DOMAIN if mark.group().strip().lower() == 'at' else SPELLED_DOMAIN).match(text, mark.end())
        if domain and start < mark.start():
            yield 'email', start, domain.end()


def _compressed(own: str) -> bool:
    """An IPv6 address with :: that stands for one group or more, and with at least one group written out."""
    return 1 <= sum(map(bool, own.split(':'))) <= 7


def _side(c: str) -> float:
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def described(text: str, span: Span) -> list[float]:
    """Numbers about the form of a span and the characters around it."""
    kind, start, end = span
    own = text[start:end]
    digits = re.sub(r'\D', '', own)
    groups = [len(g) for g in re.findall(r'[0-9]+', own)]
    letters = sum(c.isalpha() for c in own)
    before = text[max(0, start - 40):start]
    octets = [int(g) for g in re.findall(r'[0-9]+', own)] if kind == 'ip' and len(own) < 40 else []
    return ([float(kind == k) for k in KINDS]
            + [float(len(own)), float(len(digits)), float(letters), float(len(groups)),
               float(groups[0] if groups else 0), float(groups[-1] if groups else 0),
               len(digits) / len(own), len(set(own)) / len(own), float(own[0] == '+'), float('(' in own),
               float('-' in own), float('.' in own), float(' ' in own), float(':' in own),
               float(13 <= len(digits) <= 19 and luhn(digits)), float(bool(octets) and max(octets) <= 255),
               float(bool(re.fullmatch('[0-9a-f]+|[0-9A-F]+', own))), float(bool(re.search('[a-z]', own)) and bool(re.search('[A-Z]', own))),
               float('[' in own or '{' in own), float(bool(re.search(r'\bdot\b', own, re.I))), float(kind == 'ssn' and ssn_ranges(digits)),
               _side(text[start - 1:start]), _side(text[end:end + 1]), float(before.rstrip()[-1:] in ('=', ':')),
               float(text[start - 1:start] in ('"', "'"))]
            + [float(bool(h.search(before))) for h in HINTS])


class Cover:
    """Spans sorted by start, with the furthest end so far: whether another touches one takes a bisect."""

    def __init__(self, spans: list[Span]):
        ordered = sorted((start, end) for _, start, end in spans)
        self.starts = [start for start, _ in ordered]
        self.ends = list(accumulate((end for _, end in ordered), max))

    def touches(self, span: Span) -> bool:
        before = bisect_left(self.starts, span[2])
        return before > 0 and self.ends[before - 1] > span[1]


def placed(taken: list[tuple[int, int]], span: Span) -> bool:
    """Put the span among sorted ones that do not overlap, unless it touches one."""
    at = bisect_left(taken, (span[2],))
    free = not at or taken[at - 1][1] <= span[1]
    if free:
        taken.insert(at, (span[1], span[2]))
    return free


def ssn_ranges(digits: str) -> bool:
    """The nine digits lie in ranges that are given out."""
    return digits[:3] not in ('000', '666') and digits[:1] != '9' and digits[3:5] != '00' and digits[5:] != '0000'


NAMED_SECRET = re.compile(r'(?:token|key|secret|password|passwd|auth)\w*\s*[=:]\s*["\']?$', re.I)
OTHER_NUMBER = re.compile(r'\b(?:order|invoice|version|isbn|issue|page|build|ticket|item|sku|ref|id|no|number)\W{0,3}$|#$', re.I)
DAY = re.compile(r'(?:19|20)[0-9]{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12][0-9]|3[01])')


def evidence(text: str, span: Span) -> int | None:
    """1 or 0 if something besides its form tells whether a proposal is personal data, else None: it stays unlabelled."""
    kind, start, end = span
    own, before = text[start:end], text[max(0, start - 40):start]
    digits = re.sub(r'\D', '', own)
    if kind == 'secret':
        if not any(c.isdigit() for c in own):
            return 0
        return 1 if NAMED_SECRET.search(before) else None
    if kind == 'email':
        # Two sentences with no blank between them.
        return 0 if re.search(r'[a-z]\.[A-Z][a-z]*\Z', own) and ' at ' in own else None
    if before[-1:].isalnum() or text[end:end + 1].isalnum() or '_' in (before[-1:], text[end:end + 1]):
        return 0
    if OTHER_NUMBER.search(before) or kind == 'card' and not (13 <= len(digits) <= 19 and luhn(digits)) \
            or kind == 'phone' and DAY.fullmatch(own) or kind == 'ssn' and not ssn_ranges(digits) \
            or kind == 'ip' and ('.' in own and max(map(int, own.split('.'))) > 255 or '::' in own and not digits):
        return 0
    return None


def examples(text: str, seed: str, unlabelled: bool = False) -> Iterator[tuple[str, Span, int]]:
    """(text, span in it, label) from one document: its proposals, and rewritten base matches in their places.

    ``unlabelled`` adds the proposals without a label, as label 2.
    """
    base, rng = base_spans(text), Random(seed)
    kept, cover = set(base), Cover(base)
    for span in proposals(text):
        if span in kept:
            yield text, span, 1
        elif not cover.touches(span):
            label = evidence(text, span)
            if label is not None or unlabelled:
                yield text, span, 2 if label is None else label

    def put(kind: str, start: int, end: int, own: str, label: int) -> tuple[str, Span, int]:
        at = min(start, 60)
        return text[max(0, start - 60):start] + own + text[end:end + 20], (kind, at, at + len(own)), label

    number = lambda n: ''.join(rng.choice('0123456789') for _ in range(n))
    for kind, start, end in base:
        own = text[start:end]
        digits = re.sub(r'\D', '', own)
        if kind == 'phone':
            d = (digits + number(10))[-10:]
            for form in ('({}) {}-{}', '({}){}-{}', '{}-{}-{}', '{}.{}.{}', '{} {} {}', f'+{digits[:1] or 1} ({{}}) {{}}-{{}}',
                         f'+{digits[:2]} {{}} {{}} {{}}', f'+{digits[:2]}{{}}{{}}{{}}'):
                yield put('phone', start, end, form.format(d[:3], d[3:6], d[6:]), 1)
        elif kind == 'email':
            user, _, host = own.partition('@')
            yield put('email', start, end, f'{user} [at] {host}', 1)
            yield put('email', start, end, f'{user}(at){host.replace(".", "(dot)")}', 1)
            yield put('email', start, end, f'{user} at {host.replace(".", " dot ")}', 1)
            yield put('email', start, end, f'{user} [At] {host}', 1)
            yield put('email', start, end, f'{user} at {host}', 1)
            yield put('email', start, end, f'{user} AT {host.replace(".", " DOT ")}', 1)
            plain = [''.join(rng.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(rng.randrange(2, 10))) for _ in range(3)]
            yield put('email', start, end, '{} [at] {}.{}'.format(*plain), 1)
            yield put('email', start, end, '{} at {} dot {}'.format(*plain), 1)
            yield put('email', start, end, '{} at {}.{}'.format(*plain), 0)
            yield put('email', start, end, '{} at {}.{}'.format(*plain[:2], plain[2].title()), 0)
        elif kind == 'ip':
            yield put('ip', start, end, ':'.join(f'{rng.randrange(65536):x}' for _ in range(8)), 1)
            groups = [f'{rng.randrange(1, 65536):x}' for _ in range(rng.randrange(2, 7))]
            cut = rng.randrange(1, len(groups) + 1)
            yield put('ip', start, end, ':'.join(groups[:cut]) + '::' + ':'.join(groups[cut:]), 1)
            yield put('ip', start, end, '::'.join(rng.choice(WORDS) for _ in range(2)), 0)
            wrong = [rng.choice((rng.randrange(10), rng.randrange(256))) for _ in range(4)]
            wrong[rng.randrange(4)] = rng.randrange(256, 1000)
            yield put('ip', start, end, '.'.join(map(str, wrong)), 0)
        elif kind == 'card':
            wrong = digits[:-1] + str((int(digits[-1]) + 1 + rng.randrange(9)) % 10)
            for number_, label in ((digits, 1), (wrong, 0)):
                yield put('card', start, end, number_, label)
                if len(number_) == 16:
                    yield put('card', start, end, ' '.join(number_[i:i + 4] for i in range(0, 16, 4)), label)
                    yield put('card', start, end, '-'.join(number_[i:i + 4] for i in range(0, 16, 4)), label)
        area, group, serial = f'{rng.randrange(1, 666):03d}', f'{rng.randrange(1, 100):02d}', f'{rng.randrange(1, 10000):04d}'
        yield put('ssn', start, end, f'{area}-{group}-{serial}', 1)
        never = rng.choice([('000', group, serial), ('666', group, serial), (f'9{number(2)}', group, serial), (area, '00', serial), (area, group, '0000')])
        yield put('ssn', start, end, '-'.join(never), 0)
        yield put('phone', start, end, number(rng.randrange(7, 13)), 0)
        yield put('phone', start, end, f'{rng.randrange(1900, 2100)}{rng.randrange(1, 13):02d}{rng.randrange(1, 29):02d}', 0)
        yield put('secret', start, end, ''.join(rng.choice('abcdefghijklmnopqrstuvwxyz') for _ in range(rng.randrange(20, 40))), 0)


@dataclass
class Detector:
    trees: Boosted
    thresholds: dict[str, float]

    def more(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Per text, the proposals over their kind's threshold that touch neither a base match nor a better proposal."""
        open_, rows = [], []
        for i, (text, own) in enumerate(zip(texts, base)):
            cover = Cover(own)
            for span in proposals(text):
                if self.thresholds[span[0]] <= 1 and not cover.touches(span):
                    open_.append((i, span))
                    rows.append(described(text, span))
        out: list[list[Span]] = [[] for _ in texts]
        taken: list[list[tuple[int, int]]] = [[] for _ in texts]
        if rows:
            scores = self.trees.predict(np.array(rows))
            for score, (i, span) in sorted(zip(scores, open_), key=lambda x: (-x[0], x[1])):
                if score >= self.thresholds[span[0]] and placed(taken[i], span):
                    out[i].append(span)
        return out


def learn(docs: DataFrame, most: int = FIT_EXAMPLES, precision: float = PRECISION) -> Detector:
    """Fit trees on a sample of the examples in ``docs``, set thresholds from all others.

    Per kind and label the trees get the ``most`` examples whose hash is lowest, of documents outside
    the fold kept back. A document that gave none counts for the thresholds, with all its examples;
    Spark sums them per kind and score bin, so the driver gets at most 2 * 6 * ``most`` examples and
    18 * 1,202 sums. Equal texts share a fold and count once for the trees; the draw narrows in steps, so no
    task sees more than some 130,000 examples. Thresholds: see :func:`thresholds_of`. The result does not
    depend on the order of the rows.
    """
    texts = docs.select(whole_text().alias('text')).select(leading_bits(F.col('text'), 15).alias('_order'), 'text')
    drawn = texts.mapInArrow(lambda batches: _drawn(batches, most), 'kind int, label int, _hash bigint, _order bigint, x array<double>')
    drawn = drawn.withColumn('_task', F.spark_partition_id())
    for lots in DRAW_STEPS:
        rank = F.dense_rank().over(Window.partitionBy('kind', 'label', F.col('_task') % lots).orderBy('_hash'))
        drawn = drawn.withColumn('_rank', rank).filter(F.col('_rank') <= most).drop('_rank')
    rows = drawn.dropDuplicates(['kind', 'label', '_hash']).collect()
    rows = sorted((r.kind, r.label, r._hash, r._order, tuple(r.x)) for r in rows)
    trees = boost(np.array([r[4] for r in rows]), np.array([r[1] for r in rows], float))
    fitted = frozenset(r[3] for r in rows)
    sums = np.zeros((len(KINDS), len(BINS), 3))
    for r in (texts.mapInArrow(lambda batches: _binned(batches, trees, fitted), 'kind int, bin int, label int, n bigint')
              .groupBy('kind', 'bin', 'label').agg(F.sum('n').alias('n')).collect()):
        sums[r.kind, r.bin, r.label] = r.n
    return Detector(trees, thresholds_of(sums, precision))


def thresholds_of(sums: np.ndarray, precision: float) -> dict[str, float]:
    """Per kind the threshold, from proposals counted by kind, score bin and label (negative, positive, unlabelled).

    It is the lowest bin, and not under 0.5, from which on two shares reach ``precision``: the positives among
    the labelled examples, and the estimated ones among the unlabelled. For the latter, the unlabelled
    proposals are taken as a mixture of positives, which score 0.5 or more, and of negatives spread over
    the scores as the labelled ones are; so those under 0.5 tell how many negatives there are, and how many
    of these to expect above a threshold. A kind without positive examples takes the threshold of all kinds
    together; one that never gets that precise adds no spans (2). Both are logged.
    """
    half = int(np.searchsorted(BINS, 0.5))

    def lowest(own: np.ndarray) -> float:
        above = own[::-1].cumsum(0)[::-1]
        good = (above[:, 1] > 0) & (above[:, 1] >= precision * above[:, :2].sum(1))
        if own.shape[1] > 2 and above[0, 2]:
            low = max(above[0, 0] - above[half, 0], 1.0)
            negatives = (above[0, 2] - above[half, 2]) / low * above[:, 0]
            good &= (1 - precision) * above[:, 2] >= np.minimum(negatives, above[:, 2])
        at = np.flatnonzero(good & (BINS >= 0.5))
        return float(BINS[at[0]]) if len(at) else 2.0

    out = {}
    for kind, own in zip(KINDS, sums):
        unseen = not own[:, 1].any()
        out[kind] = lowest(sums.sum(0) if unseen else own)
        if unseen:
            LOG.warning('%s: no positive example kept back, the threshold is that of all kinds (%.3f)', kind, out[kind])
        elif out[kind] > 1:
            LOG.warning('%s: no threshold reaches a precision of %g, only fixed patterns count', kind, precision)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str]]:
    for batch in batches:
        for piece in slices(batch, 'text'):
            yield from zip(piece.column('_order').to_pylist(), piece.column('text').to_pylist())


def _drawn(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Per kind and label the ``most`` examples of these rows with the lowest hash; only such are described."""
    kept: dict[tuple[int, int], tuple[list[int], dict]] = {}
    for order, text in _texts(batches):
        if order % FOLDS == 0:
            continue
        for n, (around, span, label) in enumerate(examples(text, str(order))):
            heap, rows = kept.setdefault((KINDS.index(span[0]), label), ([], {}))
            own = int.from_bytes(hashlib.blake2b(f'{order}:{n}'.encode(), digest_size=7).digest())
            if own in rows or len(heap) >= most and own > -heap[0]:
                continue
            if len(heap) < most:
                heappush(heap, -own)
            else:
                del rows[-heappushpop(heap, -own)]
            rows[own] = order, np.array(described(around, span))
    for (kind, label), (_, rows) in kept.items():
        orders, x = zip(*rows.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([kind] * len(x), pa.int32()), pa.array([label] * len(x), pa.int32()), pa.array(list(rows), pa.int64()),
             pa.array(orders, pa.int64()), pa.array(x, pa.list_(pa.float64()))],
            names=['kind', 'label', '_hash', '_order', 'x'])


def _binned(batches: Iterator[pa.RecordBatch], trees: Boosted, fitted: frozenset[int]) -> Iterator[pa.RecordBatch]:
    """Examples of documents that gave the trees none, counted by kind, bin of their score, and label."""
    sums = np.zeros((len(KINDS), len(BINS), 3), np.int64)
    kinds, labels, x = [], [], []

    def count() -> None:
        bins = np.searchsorted(BINS, trees.predict(np.array(x)), 'right') - 1
        np.add.at(sums, (np.array(kinds), bins, np.array(labels)), 1)
        for part in (kinds, labels, x):
            part.clear()

    for order, text in _texts(batches):
        if order in fitted:
            continue
        for around, span, label in examples(text, str(order), unlabelled=True):
            kinds.append(KINDS.index(span[0]))
            labels.append(label)
            x.append(described(around, span))
            if len(x) >= SCORED_AT_ONCE:
                count()
    if x:
        count()
    at = np.nonzero(sums)
    yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.int32()) for a in at), pa.array(sums[at], pa.int64())],
                                     names=['kind', 'bin', 'label', 'n'])


def named(spans: list[Span]) -> str:
    return ','.join(f'{k}:{s}:{e}' for k, s, e in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for every row of ``docs``.

    The counts and the digest are of the base matches, ``spans`` holds all. Needs doc_id and text;
    a NULL or empty text has no spans. Rows are independent: repeated rows get equal answers.
    """
    detector = detector or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 'text'):
                texts = piece.column('text').to_pylist()
                base = [base_spans(t) for t in texts]
                more = detector.more(texts, base)
                counts = [[sum(k == kind for k, _, _ in b) for b in base] for kind in KINDS[:4]]
                yield pa.RecordBatch.from_arrays(
                    [piece.column('doc_id'), *[pa.array(c, pa.int64()) for c in counts],
                     pa.array([hashlib.sha256(named(b).encode()).hexdigest() for b in base]),
                     pa.array([named(b + m) for b, m in zip(base, more)])],
                    names=['doc_id', 'n_email', 'n_ip', 'n_card', 'n_phone', 'base_sha256', 'spans'])

    return docs.select(doc_id(), whole_text().alias('text')).mapInArrow(
        run, 'doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string')


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first, longest one names the union."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f'[{kind.upper()}]']
        at = max(at, end)
    return ''.join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """``docs`` with all found spans of ``text`` replaced and ``n_chars``, if there, counted anew.

    Every row and column stays; NULL texts stay NULL, empty ones empty. Repeated rows are redacted alike; an
    empty table gives an empty one.
    """
    detector = detector or learn(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 'text'):
                texts = piece.column('text').to_pylist()
                full = [t or '' for t in texts]
                base = [base_spans(t) for t in full]
                more = detector.more(full, base)
                new = [t and redacted(t, b + m) for t, b, m in zip(texts, base, more)]
                columns = {n: c for n, c in zip(piece.schema.names, piece.columns)}
                columns['text'] = pa.array(new, piece.schema.field('text').type)
                if 'n_chars' in columns:
                    lengths = [None if t is None else len(t) for t in new]
                    columns['n_chars'] = pa.array(lengths, piece.schema.field('n_chars').type)
                yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.mapInArrow(run, docs.schema)


@query('op9_personal_data')
def op9_personal_data(spark, sf_dir):
    return find(documents(spark, sf_dir))
