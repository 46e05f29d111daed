"""Main text of web pages by equivalence-class template deduction.

A token is a structural tag in its context (name, classes and place below its parent, from the root) or a block of text in its
context. Over the pages of a host each token has an occurrence vector, its count on each page. Tokens with equal vectors form an
equivalence class; classes that are large and frequent enough make up the host's template. A tag token names its whole path, so classes nest as
the elements do. What stands between template tags are slots. Text that is itself a template token is the same on nearly all pages and goes, save headings of the
article; slots made of links go; the container is the deepest template tag whose slots hold nearly all that is left, and its slots are extracted.

Vectors are compared by an exclusive-or of hashes of (page, count), so no host's pages are ever brought together. Copies of a page
count once, or an article that stands on a host many times would become its template.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_IDS, small_batches, written

# Element names of the HTML standard, and words that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Inline elements leave a text's blocks and paths alone.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
RAW = frozenset("script style noscript template textarea title iframe svg canvas object select math audio video".split())
DROPPED = frozenset("head nav footer aside form button menu dialog fieldset".split()) | RAW
MAIN = frozenset("article main".split())
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header login masthead menu modal nav navbar navigation "
    "newsletter notice notices overlay pager pagination popup promo promoted promotion related reply replies respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget widgets".split()
)
#: Words that say nothing beside those: a name is boilerplate's if all its words are in either list and one is in the first.
PLAIN_WORDS = frozenset(
    "area article bar block body bottom box btn button buttons card center col column container content cta foot form global group head icon icons inline inner item items layer layout left link links list main message middle msg name "
    "outer page panel post posts right row section side site slot small sticky sub text title top unit view wrap wrapper".split()
)
#: Elements of text itself, whose names say nothing about their place in a template and that hold no article as a whole.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th tr tbody thead figcaption".split())
#: Elements inside which a paragraph further out stays open.
P_SCOPE = frozenset("td th li article section div button".split())
#: Elements that an element of the same kind, or one of these, ends when it starts.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SELF_ENDING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Elements that name what follows: the same ones may stand in every article of a host.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 dt th figcaption".split())

#: A host has a template if so many different pages of it are known.
MIN_PAGES = 4
#: Shares of a host's pages that a template's tags and its constant texts stand on at least; tokens of a class at least.
SUPPORT, TEXT_SUPPORT, CLASS_TOKENS = 0.5, 0.8, 2
#: A container has this share of the text around it; a slot with more than this share of its text in links is a list of links.
CONTAINER_SHARE, LINK_SHARE = 0.8, 0.5
#: Hosts with a template that are broadcast at most (some hundred bytes each); beyond it pages are joined by host and salt.
MAX_BROADCAST, SALTS = 100_000, 64

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"[>\"']")
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_ATTR = re.compile(r"([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")
ROOT = 0


def _signed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts))) - (1 << 63)


def _named_boilerplate(names: list[str]) -> bool:
    for name in names:
        words = {w.lower() for w in _WORDS.findall(name)}
        if words & BOILERPLATE_WORDS and words <= BOILERPLATE_WORDS | PLAIN_WORDS:
            return True
    return False


def _step(name: str, attr: str) -> tuple[str, bool, bool]:
    """An element's step in a path, whether it is boilerplate, and whether it is a container of an article."""
    if not attr.strip("/ \t\r\n"):
        return name, name in DROPPED, name in MAIN
    given = {k.lower(): v.strip("\"'") for k, v in _ATTR.findall(attr)}
    marks = [*given.get("class", "").split(), *given.get("id", "").split()]
    step = f"{name}.{_DIGITS.sub('0', '.'.join(marks))}".rstrip(".")
    role = given.get("role", "").lower()
    main = name in MAIN or role in ("main", "article") or given.get("itemprop", "").lower() == "articlebody"
    hidden = "hidden" in given or given.get("aria-hidden", "").lower() == "true" or "display:none" in given.get("style", "").replace(" ", "").lower()
    named = not main and name not in TEXTUAL and name not in ("html", "body") and _named_boilerplate(marks)
    return step, name in DROPPED or role in BOILERPLATE_ROLES or hidden or named, main


def _pieces(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", name, attributes) and ("close", name, "") of a page in order, in time linear in its length.

    Comments, declarations and elements whose content is no text are left out. A tag that never ends is text.
    """
    at, last = 0, page.rfind(">")
    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last and not page.startswith("<!--", lt):
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith("<![CDATA[", lt):
            end = page.find("]]>", lt)
            at = end + 3 if end >= 0 else page.find(">", lt) + 1
            continue
        if page[lt + 1 : lt + 2] in ("!", "?"):
            at = page.find(">", lt) + 1
            continue
        close = page[lt + 1 : lt + 2] == "/"
        m = _NAME.match(page, lt + 1 + close)
        if not m:
            yield "text", "<", ""
            at = lt + 1
            continue
        i, whole = m.end(), True
        while True:
            stop = _STOP.search(page, i)
            if stop and stop[0] == ">":
                end = stop.start()
                break
            i = page.find(stop[0], stop.end()) + 1 if stop else 0
            if not i:  # a quote that never ends: the tag ends at the next mark
                end, whole = page.find(">", m.end()), False
                break
        at = end + 1
        name = m[0].lower()
        if not close and name in RAW:
            over = _RAW_END[name].search(page, at)
            at = over.end() if over else len(page)
        elif whole:
            yield ("close", name, "") if close else ("open", name, page[m.end() : end])


class Page:
    """Blocks of a page in order, and the tags of its tree.

    ``blocks``: (node, boilerplate, in a semantic container, in the host's container, text, characters in links).
    ``nodes``: node -> [parent, step, times].
    """

    def __init__(self, page: str | None, container: int | None = None, dropped: frozenset[int] = frozenset()):
        self.blocks: list[tuple[int, bool, bool, bool, str, int]] = []
        self.nodes: dict[int, list] = {ROOT: [ROOT, "", 1]}
        names: list[str] = []
        open_names: Counter[str] = Counter()
        #: node, boilerplate, semantic container, host's container, place of an open paragraph
        state: list[tuple[int, bool, bool, bool, int]] = [(ROOT, False, False, container == ROOT, -1)]
        #: how often each step was taken below each open element
        steps: list[dict[str, int]] = [{}]
        parts: list[str] = []
        linked, in_link = 0, False
        known: dict[tuple[int, str], int] = {}

        def cut(depth: int) -> None:
            for n in names[depth:]:
                open_names[n] -= 1
            del names[depth:], state[depth + 1 :], steps[depth + 1 :]

        for kind, what, attr in _pieces(page or ""):
            if kind == "text":
                parts.append(what)
                linked += len(what) * in_link
                continue
            name = what
            if name in INLINE:
                if name == "br":
                    parts.append(" ")
                elif name == "a":
                    in_link = kind == "open"
                continue
            if parts:
                text = " ".join(entities.unescape("".join(parts)).split())
                if text:
                    self.blocks.append((*state[-1][:4], text, min(linked, len(text))))
                parts.clear()
                linked = 0
            if kind == "close":
                in_link = False
                if name == "p":
                    if state[-1][4] >= 0:
                        cut(state[-1][4])
                elif open_names[name] > 0:
                    depth = len(names) - 1
                    while names[depth] != name:
                        depth -= 1
                    cut(depth)
                continue
            ends = SELF_ENDING.get(name)
            if name in ENDS_P and state[-1][4] >= 0:
                cut(state[-1][4])
            elif ends and names and names[-1] in ends:
                cut(len(names) - 1)
                if name == "tr" and names and names[-1] == "tr":
                    cut(len(names) - 1)
            parent, bad, main, inside, p_at = state[-1]
            step, own_bad, own_main = _step(name, attr)
            if name not in TEXTUAL:  # elements alike in name are told apart by their order below one parent
                nth = steps[-1][step] = steps[-1].get(step, 0) + 1
                if nth > 1:
                    step = f"{step}[{nth}]"
            if name == "header" and not main:
                own_bad = True
            node = known.get((parent, step))
            if node is None:
                node = known[parent, step] = _signed(parent, step)
            seen = self.nodes.get(node)
            if seen:
                seen[2] += 1
            else:
                self.nodes[node] = [parent, step, 1]
            if name in VOID or attr.endswith("/"):
                continue
            is_container = node == container
            names.append(name)
            steps.append({})
            open_names[name] += 1
            place = len(names) - 1 if name == "p" else -1 if name in P_SCOPE else p_at
            # the deduced container overrules what names say about it and what is around it
            state.append((node, not is_container and (bad or own_bad or node in dropped), main or (own_main and not bad and not own_bad), inside or is_container, place))
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                self.blocks.append((*state[-1][:4], text, min(linked, len(text))))


def text_token(node: int, text: str) -> int:
    return _signed(node, "text", text)


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each (host, token) in a batch: exclusive-or of its vector's hashes, pages, occurrences; of tags their parent, step, characters and those in links."""
    names = ["host", "token", "is_text", "parent", "step", "vector", "pages", "times", "chars", "links"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), *[pa.int64()] * 5]
    for batch in batches:
        sums: dict[tuple[str, int], list] = {}
        for host, key, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            page = Page(html)
            texts: dict[int, list[int]] = {}
            chars: dict[int, list[int]] = {}
            for node, bad, _, _, text, links in page.blocks:
                t = texts.setdefault(text_token(node, text), [node, 0, len(text), links])
                t[1] += 1
                if not bad:
                    c = chars.setdefault(node, [0, 0])
                    c[0] += len(text)
                    c[1] += links
            for token, (parent, step, n) in page.nodes.items():
                a, b = chars.get(token, (0, 0))
                s = sums.setdefault((host, token), [False, parent, step, 0, 0, 0, 0, 0])
                s[3] ^= _signed(key, n)
                for i, x in enumerate((1, n, a, b), 4):
                    s[i] += x
            for token, (node, n, a, b) in texts.items():
                s = sums.setdefault((host, token), [True, node, None, 0, 0, 0, 0, 0])
                s[3] ^= _signed(key, n)
                for i, x in enumerate((1, n, a * n, b * n), 4):
                    s[i] += x
        rows = [(*k, *v) for k, v in sums.items()]
        columns = [list(c) for c in zip(*rows, strict=True)] or [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)


def deduced(tokens: pd.DataFrame) -> tuple[int, str, list[list[str]], list[int], list[int]]:
    """Of a host's frequent tokens: container and its path, the template's classes, its link slots and its constant texts.

    Without a valid class there is no template, and the container is the root.
    """
    parent = dict(zip(tokens.token, tokens.parent, strict=True))
    step = dict(zip(tokens.token, tokens.step, strict=True))
    is_text = dict(zip(tokens.token, tokens.is_text, strict=True))
    # tokens with one vector are a class, which is valid with enough tokens; as tokens name their paths, what is inside a tag is below it
    classes = [sorted(g.token) for _, g in tokens.groupby(["vector", "pages", "times"], sort=True)]
    valid = [c for c in classes if len(c) >= CLASS_TOKENS]
    template = {t for c in valid for t in c}
    tags = {t for t in template if not is_text[t]}
    constant = [t for t in template if is_text[t]]
    shown = [[step[t] or "text" for t in c if t in template] for c in valid]
    if not tags - {ROOT}:
        return ROOT, "", shown, [], []
    # text of each slot: what stands under a template tag and under no deeper one, less constant text
    own = {t: [0, 0] for t in tags | {ROOT}}

    def slot(t: int) -> int:
        while t not in own:
            t = parent.get(t, ROOT)
        return t

    for t, text, a, b in zip(tokens.token, tokens.is_text, tokens.chars, tokens.links, strict=True):
        if not text:
            own[slot(t)][0] += a
            own[slot(t)][1] += b
        elif t in template:
            own[slot(parent[t])][0] -= a
            own[slot(parent[t])][1] -= b
    children: dict[int, list[int]] = {}
    for t in tags - {ROOT}:
        children.setdefault(slot(parent[t]), []).append(t)
    order, todo = [], [ROOT]
    while todo:
        order.append(todo.pop())
        todo += children.get(order[-1], [])
    below = {t: list(own[t]) for t in order}
    for t in reversed(order):
        for c in children.get(t, []):
            below[t] = [x + y for x, y in zip(below[t], below[c], strict=True)]
    name = {t: re.split(r"[.\[]", step[t] or "")[0] if t != ROOT else "" for t in order}
    lists = [t for t in order if name[t] not in TEXTUAL and t != ROOT and below[t][0] > 0 and below[t][1] > LINK_SHARE * below[t][0]]
    linky = set(lists)
    body = {t: 0 for t in order}
    for t in reversed(order):
        body[t] = max(own[t][0], 0) + sum(body[c] for c in children.get(t, []) if c not in linky)
    at = ROOT
    while True:
        inner = [c for c in children.get(at, []) if name[c] not in TEXTUAL and c not in linky]
        best = max(inner, key=lambda c: (body[c], -c), default=None)
        if best is None or not body[best] or body[best] < CONTAINER_SHARE * body[at]:
            break
        at = best
    def names(t: int) -> bool:
        """Whether a constant text is a heading of the article: it stands in a slot of the container that holds text of its own beside it."""
        t = parent[t]
        if re.split(r"[.\[]", step.get(t) or "")[0] not in HEADINGS:
            return False
        while t != ROOT and re.split(r"[.\[]", step.get(t) or "")[0] in TEXTUAL:
            t = parent.get(t, ROOT)
        t = holder = slot(t)
        while t not in (at, ROOT) and t not in linky:
            t = slot(parent[t])
        return t == at and body[holder] > 0

    path, t = [], at
    while t != ROOT:
        path.append(step[t])
        t = parent[t]
    return at, "/" + "/".join(reversed(path)), shown, sorted(linky), sorted(t for t in constant if not names(t))


def _template(frame: pd.DataFrame) -> pd.DataFrame:
    node, path, classes, lists, constant = deduced(frame)
    return pd.DataFrame({"host": [frame.host.iloc[0]], "node": [node], "container": [path], "template": [classes], "lists": [lists], "constant": [constant]})


def extract(page: str | None, container: int | None = None, lists: frozenset[int] = frozenset(), constant: frozenset[int] = frozenset()) -> str:
    """Main text of a page: the container's slots less constant text and lists of links.

    Without a template, or where it leaves nothing, semantic tags and names decide: the blocks of semantic containers if they are at least half of what
    is no boilerplate, else all of that.
    """
    if container is not None:
        found = Page(page, container, lists)
        own = [b for b in found.blocks if not b[1] and b[3]]
        left = [b[4] for b in own if text_token(b[0], b[4]) not in constant]
        if left or own and constant:
            return "\n".join(left or (b[4] for b in own))
    blocks = [b for b in Page(page).blocks if not b[1]]
    own = [b for b in blocks if b[2]]
    if 2 * sum(len(b[4]) for b in own) < sum(len(b[4]) for b in blocks):
        own = blocks
    return "\n".join(b[4] for b in own)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, node, lists, constant in zip(*(batch.column(i) for i in range(2, 6)), strict=True):
            texts.append(extract(page.as_py(), node.as_py(), frozenset(lists.as_py() or ()), frozenset(constant.as_py() or ())))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _by_host(rows: DataFrame, told: DataFrame, few: bool, how: str, salt: list[str]) -> DataFrame:
    """Rows joined to a table with a row for each host: broadcast if there are few, else by host and salt."""
    if few:
        return rows.join(F.broadcast(told), "host", how)
    salted = told.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64(*salt), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], how).drop("salt")


def _different(pages: DataFrame) -> DataFrame:
    """host, key and html of pages, of equal ones on a host that with the smallest key."""
    keyed = pages.select("host", F.concat_ws(" ", F.col("page_id").cast("string"), "url").alias("key"), "html", F.xxhash64("html").alias("h"))
    again = written(keyed.groupBy("host", "h").agg(F.min("key").alias("first"), F.count("*").alias("n")).where("n > 1").select("host", "h", "first"), "page-copies")
    told = keyed.join(F.broadcast(again) if again.count() <= MAX_BROADCAST_IDS // 4 else again, ["host", "h"], "left")
    return told.where(F.col("first").isNull() | (F.col("first") == F.col("key"))).select("host", "key", "html")


def templates(pages: DataFrame) -> DataFrame:
    """host, node, container, template (classes of tags and texts), lists and constant of every host with MIN_PAGES different pages; ``pages`` has host, page_id, url and html."""
    schema = "host string, token long, is_text boolean, parent long, step string, vector long, pages long, times long, chars long, links long"
    counted = _different(pages).mapInArrow(_vectors, schema)
    vectors = counted.groupBy("host", "token").agg(*[F.first(c).alias(c) for c in ("is_text", "parent", "step")], F.bit_xor("vector").alias("vector"), *[F.sum(c).alias(c) for c in ("pages", "times", "chars", "links")])
    vectors = written(vectors.where(F.col("pages") >= MIN_PAGES * SUPPORT), "page-tokens")
    sizes = vectors.where(F.col("token") == ROOT).where(F.col("pages") >= MIN_PAGES).select("host", F.col("pages").alias("host_pages"))
    known = _by_host(vectors, sizes, sizes.count() <= MAX_BROADCAST, "inner", ["token"])
    # a page has each token once or more, so a host has at most 1 / SUPPORT times a page's tokens left
    frequent = known.where(F.col("pages") >= F.when(F.col("is_text"), F.lit(TEXT_SUPPORT)).otherwise(F.lit(SUPPORT)) * F.col("host_pages")).drop("host_pages")
    schema = "host string, node long, container string, template array<array<string>>, lists array<long>, constant array<long>"
    return frequent.groupBy("host").applyInPandas(_template, schema)


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Character references are decoded, white space inside a block becomes one space (a line-break element is white space),
    blocks are joined by a line feed. Null and empty pages have an empty text. Rows without a url share the host without
    a name; repeated rows are extracted each. Broken markup is read as far as it goes: a tag that never ends is text, an
    element that never ends goes to the end of what holds it. Hosts with under MIN_PAGES different pages have no template: there, and on pages without the
    host's container, semantic tags and names decide. Pages stay where they are read unless very many hosts have a template.
    """
    host = F.regexp_extract(F.lower(F.coalesce(F.col("url").cast("string"), F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = small_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    told = written(templates(rows).where(F.col("node") != ROOT).select("host", "node", "lists", "constant"), "page-templates")
    count, longs = told.agg(F.count("*"), F.sum(F.size("lists") + F.size("constant"))).first()
    few = count + (longs or 0) / 16 <= MAX_BROADCAST
    asked = _by_host(rows, told, few, "left", ["page_id", "url"]).select("page_id", "url", "html", "node", "lists", "constant")
    return asked.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
