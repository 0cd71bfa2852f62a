"""Main text of web pages by nearest-URL page differencing.

A page becomes lines: one per block, with character references decoded and white space folded. Lines inside elements that
are never main text (menus, headers and footers of the page, sidebars, notices, adverts, forms, reader comments, scripts,
styles) are marked as such by tag, role, class or id. Pages are ordered by host and URL path, and each is aligned by longest
common subsequences of lines with the pages around it in that order: ``AROUND`` different pages on each side. The nearest
that is not a copy, by shared path and then by place, decides: the lines it shares are the site's template and are deleted.
Lines inside the page's ``article`` (or, without one, ``main``) need more: they are deleted when at least ``AGREE`` pages
that are no copies were compared and all of the nearest ``FURTHER`` of them share the line. Lines outside an article stay unless the
deciding page has them; tags alone decide where no page but copies could be compared.

Two pages are copies if their lines are equal. If they share ``COPY`` of their lines, the pages around tell a copy from a
large template: what a third page has is taken out of both, and the two are copies unless most third pages leave less than
``COPY`` in common. A page without an article that has only copies around it keeps all its lines.

Pages are dealt to tasks in blocks of their order. Blocks get the pages around their ends as well, found from the urls
first, so the result does not depend on where blocks end.

Defined results: a null html counts as empty and gives an empty text; a null or malformed URL counts as an empty host and
path; repeated rows are each returned; an empty table gives no rows; other input columns are not carried.
"""

from __future__ import annotations

import html as _html
import re
from collections import deque
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.session import cut_lineage

#: Share of a page's lines in common with its neighbour from which the two count as copies.
COPY = 0.8
#: Different pages looked at on each side; of those that are no copies, how many an article's lines are held against, at least and at most.
AROUND, AGREE, FURTHER = 4, 2, 4
#: Sampled pages per block end.
SAMPLED = 20

# Element names of the HTML standard by their role here, and words of class, id or role attributes.
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_DROP = frozenset("nav footer aside form noscript template button select option svg object canvas audio video dialog menu head datalist fieldset".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li listing main menu nav ol option optgroup p plaintext pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_CLOSING = frozenset("p li dt dd td th tr option".split())
_CHROME = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer gdpr masthead menu modal "
    "nav navbar navigation newsletter notice notices notification overlay pagination popup promo promotion recommended related respond share sharing "
    "sidebar sidebars signup social sponsor sponsored subscribe subscription toolbar widget widgets contentinfo complementary search".split()
)
_NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*+)")
_SHORT_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]{0,40}+)(?=[\s/>])(?:[^>"']{1,500}+|"[^"]{0,500}+"|'[^']{0,500}+'){0,16}+>""")
_QUOTE_OR_END = re.compile(r"[>\"']")
_ATTRIBUTE = re.compile(r"(?:^|[\s/\"'])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_SPACE = re.compile(r"\s+")

Line = tuple[str, bool]  # text, inside the page's own article


def _is_chrome(attributes: str) -> bool:
    for name, value in _ATTRIBUTE.findall(attributes):
        value = value.strip("\"'")
        match name.lower():
            case "hidden":
                return True
            case "aria-hidden":
                if value.lower() == "true":
                    return True
            case "style":
                if _HIDDEN.search(value):
                    return True
            case _:
                if any(w.lower() in _CHROME for w in _WORDS.findall(value)):
                    return True
    return False


def _tags(html: str) -> Iterator[tuple[int, int, str, str, int]]:
    """Start, end, slash, name and attributes' start of each tag; comments and declarations have no name.

    ``send`` goes on from a place. A tag whose quotes never close ends at the next ``>``, and so do those after it, which
    keeps the whole scan linear; where no ``>`` follows, the rest is text.
    """
    at, quotes = 0, True
    while (start := html.find("<", at)) >= 0:
        if quotes and (m := _SHORT_TAG.match(html, start)):
            at = m.end()
            went = yield start, at, m[1], m[2].lower(), m.end(2)
            if went is not None:
                at = went
                yield start, at, "", "", at
            continue
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(html)
            yield start, at, "", "", at
            continue
        m = _NAME.match(html, start + 1)
        if not m and html[start + 1 : start + 2] not in ("!", "?", "/"):
            at = start + 1
            continue
        after = end = m.end() if m else start + 2
        while m and quotes:
            q = _QUOTE_OR_END.search(html, end)
            if q and q[0] == ">":
                end = q.start()
                break
            close = html.find(q[0], q.end()) if q else -1
            if close < 0:
                quotes = False
            end = close + 1
        else:
            end = html.find(">", after)
            if end < 0:
                return
        at = end + 1
        went = yield (start, at, m[1], m[2].lower(), after) if m else (start, at, "", "", after)
        if went is not None:
            at = went
            yield start, at, "", "", at


def _raw_end(html: str, name: str, at: int) -> int:
    """Where the raw text of an element ends, with its end tag; the end of the page where it has none."""
    m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.IGNORECASE).search(html, at)
    end = html.find(">", m.end()) if m else -1
    return end + 1 if end >= 0 else len(html)


def page_lines(html: str) -> list[Line]:
    """The lines of a page outside its chrome, in page order."""
    lines: list[list] = []  # text, in article, in main
    buffer: list[str] = []
    article = main = depth = 0
    skip = ""

    def flush() -> None:
        if buffer:
            text = _SPACE.sub(" ", _html.unescape("".join(buffer))).strip()
            buffer.clear()
            if text:
                lines.append([text, article > 0, main > 0])

    at = 0
    tags = _tags(html)
    for start, end, slash, name, after in tags:
        if not skip:
            buffer.append(html[at:start])
        at = end
        if not name:
            continue
        closing = bool(slash)
        if name in _RAW and not closing:
            at = _raw_end(html, name, at)
            tags.send(at)
            continue
        if skip:
            if skip in _SELF_CLOSING and (closing or name in _BLOCK) and name != "br":
                skip = ""
                if closing and name == "p":
                    continue
            elif name == skip:
                depth += -1 if closing else 1
                if not depth:
                    skip = ""
                continue
            elif name in ("article", "main") and not closing and skip != "head" and not _is_chrome(html[after : end - 1]):
                skip = ""  # an element left open ends where the text begins
            elif name == "body" or closing and name == "html":
                skip = ""
            else:
                continue
        if name in _BLOCK:
            flush()
        if not closing and name not in _VOID:
            if name in _DROP or (name == "header" and not article) or (name not in ("html", "body") and _is_chrome(html[after : end - 1])):
                if not (name == "svg" and html[end - 2] == "/"):
                    flush()
                    skip, depth = name, 1
                continue
        if name == "article":
            article = max(0, article + (-1 if closing else 1))
        elif name == "main":
            main = max(0, main + (-1 if closing else 1))
    if not skip:
        buffer.append(html[at:])
    flush()
    own = 1 if any(x[1] for x in lines) else 2
    return [(x[0], x[own]) for x in lines]


def _masks(a: list, often: int = 64) -> Callable[[object], int]:
    """For a value, the bits of its places in ``a``; masks of rare values of a long list are made when asked for, since one for each takes n² bits."""
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    size = len(a) // 8 + 1

    def mask(found: list[int]) -> int:
        if len(found) == 1:
            return 1 << found[0]
        bits = bytearray(size)
        for i in found:
            bits[i >> 3] |= 1 << (i & 7)
        return int.from_bytes(bits, "little")

    held = {x: mask(found) for x, found in places.items() if len(a) <= 2048 or len(found) >= often}
    return lambda x: m if (m := held.get(x)) is not None else mask(places[x]) if x in places else 0


def _bit_rows(a: list, b: list, last: bool = False) -> list[int]:
    """For each prefix of ``b`` (or the last only), the bit vector whose zeros mark where the common length with prefixes of ``a`` grows."""
    mask = _masks(a)
    full = (1 << len(a)) - 1
    v, rows = full, []
    for y in b:
        u = v & mask(y)
        v = ((v + u) | (v - u)) & full
        if not last:
            rows.append(v)
    return [v] if last else rows


def _last_row(a: list, b: list) -> list[int]:
    v = _bit_rows(a, b, last=True)[-1] if b else (1 << len(a)) - 1
    out, n = [0], 0
    for c in reversed(bin(v | 1 << len(a))[3:]):
        n += c == "0"
        out.append(n)
    return out


def common_places(a: list, b: list, most: int = 50_000_000) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``; halves the task (Hirschberg) where the table is large."""
    lo, ha, hb = 0, len(a), len(b)
    while lo < ha and lo < hb and a[lo] == b[lo]:
        lo += 1
    out = list(range(lo))
    tail = []
    while ha > lo and hb > lo and a[ha - 1] == b[hb - 1]:
        ha, hb = ha - 1, hb - 1
        tail.append(ha)
    x, y = a[lo:ha], b[lo:hb]
    both = set(x).intersection(y)
    kept = [k for k, line in enumerate(x) if line in both]
    x, y = [x[k] for k in kept], [line for line in y if line in both]
    if x and y:
        if len(x) * len(y) <= most or len(y) < 2:
            rows, i, j, mid = _bit_rows(x, y), len(x) - 1, len(y) - 1, []
            while i >= 0 and j >= 0:
                if x[i] == y[j]:
                    mid.append(i)
                    i, j = i - 1, j - 1
                elif j and _zeros(rows[j], i + 1) == _zeros(rows[j - 1], i + 1):
                    j -= 1
                elif not j and not _zeros(rows[0], i + 1):
                    break
                else:
                    i -= 1
            out += [lo + kept[k] for k in reversed(mid)]
        else:
            half = len(y) // 2
            left, right = _last_row(x, y[:half]), _last_row(x[::-1], y[half:][::-1])
            cut = max(range(len(x) + 1), key=lambda k: left[k] + right[len(x) - k])
            out += [lo + kept[k] for k in common_places(x[:cut], y[:half], most)]
            out += [lo + kept[cut + k] for k in common_places(x[cut:], y[half:], most)]
    return out + tail[::-1]


def _zeros(v: int, n: int) -> int:
    return n - (v & ((1 << n) - 1)).bit_count()


def _texts(page: list[Line]) -> list[str]:
    return [t for t, _ in page]


def _is_copy(page: list[str], other: list[str], shared: set[int], third: list[list[str]]) -> bool:
    if page == other:
        return True
    if len(shared) < COPY * max(len(page), len(other)):
        return False
    ayes = noes = 0
    for t in third:
        if t in (page, other):
            continue
        has = set(t)
        a, b = [x for x in page if x not in has], [x for x in other if x not in has]
        if len(common_places(a, b)) >= COPY * max(len(a), len(b), 1):
            ayes += 1
        else:
            noes += 1
    return ayes >= noes


def text_among(page: list[Line], around: list[list[Line]]) -> str:
    """The page's text by the pages around it, the nearest first."""
    own = _texts(page)
    others = [x for x in map(_texts, around) if x]
    agreed: list[set[int]] = []
    for i, other in enumerate(others):
        shared = set(common_places(own, other)) if not set(own).isdisjoint(other) else set()
        if not _is_copy(own, other, shared, others[:i] + others[i + 1 :]):
            agreed.append(shared)
            if len(agreed) == FURTHER:
                break
    tagged = any(x for _, x in page)
    if not agreed:
        return "\n".join(t for t, x in page if x or not tagged)
    template = set.intersection(*agreed) if len(agreed) >= AGREE else set()
    return "\n".join(t for i, (t, x) in enumerate(page) if i not in (template if x else agreed[0]))


def main_text(page: list[Line], neighbour: list[Line] | None) -> str:
    """The page's text by one neighbour."""
    return text_among(page, [neighbour] if neighbour else [])


def _common_prefix(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _dealt(placed: DataFrame, order: list[str], blocks: int) -> DataFrame:
    """Rows with their block (``_block``), and for each block the different pages around its ends (``_own`` is false)."""
    spark = placed.sparkSession
    keys = cut_lineage(placed.select(*order))
    every = max(1, keys.count() // (SAMPLED * blocks))
    sampled = keys.where(F.pmod(F.xxhash64(*order), F.lit(every)) == 0).distinct().orderBy(*order).collect()
    ends = [sampled[i * len(sampled) // blocks] for i in range(1, blocks)] if sampled else []
    types = {f.name: f.dataType for f in keys.schema}
    row = lambda r: F.struct(*[F.lit(r[c]).cast(types[c]).alias(c) for c in order])
    block = F.lit(0)
    if ends:
        block = F.size(F.filter(F.array(*map(row, ends)), lambda e: e <= F.struct(*order)))
    placed = placed.withColumn("_block", block)
    if not ends:
        return placed.withColumn("_own", F.lit(True))
    pages = keys.withColumn("_block", block).groupBy("_block", "_host", "_hash")
    at = F.struct("_path", "_key")

    def side(pick, direction) -> dict[int, list]:
        best = pages.agg(pick(at).alias("_at")).select("_block", "_host", "_at._path", "_at._key", "_hash")
        nth = F.row_number().over(Window.partitionBy("_block").orderBy(*[direction(c) for c in order]))
        found: dict[int, list] = {}
        for r in best.withColumn("_n", nth).where(F.col("_n") <= AROUND + 1).orderBy("_block", "_n").collect():
            found.setdefault(r["_block"], []).append(tuple(r[c] for c in order))
        return found

    first, last = side(F.min, F.asc), side(F.max, F.desc)
    extra = []
    for b in range(blocks):
        for found, beyond in ((first, range(b + 1, blocks)), (last, range(b - 1, -1, -1))):
            seen: set = set()
            for r in (r for k in beyond for r in found.get(k, ())):
                if len(seen) > AROUND:
                    break
                seen.add((r[0], r[-1]))
                extra.append((*r, b))
    schema = T.StructType([*[T.StructField(f"{c}_", types[c]) for c in order], T.StructField("_for", T.IntegerType())])
    wanted = F.broadcast(spark.createDataFrame(extra, schema))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in order]
    around = placed.join(wanted, same).withColumn("_block", F.col("_for")).select(*placed.columns).dropDuplicates(["_block", *order])
    return placed.withColumn("_own", F.lit(True)).unionByName(around.withColumn("_own", F.lit(False)))


def extract_main_text(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(key, url, text, n_chars) for every page."""
    schema = T.StructType([pages.schema[key], pages.schema[url], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        waiting: deque[tuple] = deque()  # pages of a host whose following pages are still to come
        places: dict[int, deque[int]] = {}  # by page hash, its places among those waiting
        behind: dict[int, tuple] = {}  # by page hash, the last page before the first that waits; the nearest at the end
        left = taken = 0  # place of the first that waits, and of the next to come

        def emit() -> None:
            nonlocal left
            own, k, u, path, digest, lines = page = waiting.popleft()
            places[digest].popleft()
            if not places[digest]:
                del places[digest]
            left += 1
            if own:
                after = [waiting[p[0] - left] for d, p in sorted(places.items(), key=lambda x: x[1][0]) if d != digest][:AROUND]
                before = [x for d, x in reversed(behind.items()) if d != digest][:AROUND]
                ranked = [(-_common_prefix(path, x[3]), n, side, x[5]) for side, xs in enumerate((before, after)) for n, x in enumerate(xs)]
                out.append((k, u, text_among(lines, [x[3] for x in sorted(ranked, key=lambda x: x[:3])])))
            behind.pop(digest, None)
            behind[digest] = page
            if len(behind) > AROUND + 1:
                del behind[next(iter(behind))]

        group = None
        for batch in batches:
            small = [c.to_pylist() for i, c in enumerate(batch.columns) if i != 2]
            for place, (k, u, host, path, digest, block, own) in enumerate(zip(*small, strict=True)):
                if group != (block, host):
                    while waiting:
                        emit()
                    behind.clear()
                    group = (block, host)
                known = places.get(digest)
                lines = waiting[known[0] - left][5] if known else behind[digest][5] if digest in behind else page_lines(batch.column(2)[place].as_py() or "")
                waiting.append((own, k, u, path, digest, lines))
                places.setdefault(digest, deque()).append(taken)
                taken += 1
                while len(places) > AROUND + 1:
                    emit()
                if len(out) >= 500:
                    yield batch_of(out)
                    out.clear()
        while waiting:
            emit()
        if out:
            yield batch_of(out)

    key_type = {T.LongType: pa.int64(), T.IntegerType: pa.int32()}.get(type(schema[0].dataType), pa.string())
    names = schema.names

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        k, u, t = zip(*out, strict=True)
        arrays = [pa.array(k, key_type), pa.array(u, pa.string()), pa.array(t, pa.string()), pa.array([len(x) for x in t], pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, names)

    placed = pages.select(
        F.col(f"`{key}`").alias("_key"),
        F.col(f"`{url}`").alias("_url"),
        F.col(f"`{html}`").alias("_html"),
        F.lower(F.coalesce(F.try_parse_url(F.col(f"`{url}`"), F.lit("HOST")), F.lit(""))).alias("_host"),
        F.coalesce(F.try_parse_url(F.col(f"`{url}`"), F.lit("PATH")), F.lit("")).alias("_path"),
    )
    placed = placed.withColumn("_hash", F.xxhash64("_html"))
    order = ["_host", "_path", "_key", "_hash"]
    blocks = max(1, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = _dealt(placed, order, blocks).select("_key", "_url", "_html", "_host", "_path", "_hash", "_block", "_own")
    return dealt.repartitionById(blocks, F.col("_block")).sortWithinPartitions("_block", *order).mapInArrow(run, schema)
