"""HTML main text by a tree-structured graphical model.

A page's block elements and runs of text are the nodes of a tree. Each node is content or not; a node's own features (tag, class
words, length, share of links) give its potential, and a table for each kind of child gives the parent-child potential. Sum-product
messages upward and downward give every node's exact marginal; text runs with a marginal of 0.5 or more are the page's main text, in
page order.

Potentials are trained from labelled pages: the hand-labelled ones below, and FIT_PAGES pages of the table at most (smallest hash
of page_id), labelled by their semantic elements: text in article or main counts as content, except in elements that never hold it.

Defined results: null or empty html, and pages without content, give an empty text. Rows that repeat are extracted row by row.
Unclosed and stray tags are repaired as browsers do for p, li and tables; depth is bounded by memory only. An element that is
dropped (svg, object and the like) but has no end tag in the block that holds it takes nothing along; the slash of script and style tags
means nothing. Attributes are data, whatever they hold. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_PAGES = 120
#: Longer pages aren't trained on, so that the sample stays small; all are extracted.
FIT_CHARS = 200_000

# Elements of HTML by what they do to the text around them.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
DROPPED = set("script style head noscript template iframe object svg canvas audio video".split())
#: What a head may hold; anything else ends it, as its end tag may be left out.
IN_HEAD = set("base basefont bgsound link meta title noscript script style template noframes head html".split())
BLOCKS = set(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html label legend li main menu nav ol option p pre section select summary table tbody td textarea tfoot th thead tr ul".split()
)
CLOSES_P = BLOCKS - {"button", "label", "option", "select", "textarea", "body", "html"}
CLOSED_BY_SELF = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}}
NEVER = set("nav footer aside form button select textarea menu dialog fieldset option label".split())
# Words of class and id attributes by what they tell.
FAMILIES = {
    "advert": "ad ads adv advert advertisement adsense banner sponsor sponsored promo promotion promoted",
    "comment": "comment comments reply replies disqus respond discussion reader",
    "notice": "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe paywall message toast warning",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs links",
    "side": "sidebar side aside widget related recommended share social trending popular tags tag author bio rail",
    "frame": "footer header masthead copyright topbar bottom site branding logo legal",
    "text": "content article post entry story main body text prose copy page",
}
WORDS = {w: f for f, ws in FAMILIES.items() for w in ws.split()}
LETTERS = re.compile("[a-z]+")
END_OF_DROPPED = re.compile("</(" + "|".join(sorted(DROPPED)) + r")(?=[\s/>])", re.IGNORECASE)


class Open:
    """A stack of tags that knows where each tag stands last, so that looking one up takes constant time."""

    def __init__(self):
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)

    def last(self, tag: str) -> int:
        """Place of the last tag of that name; -1 if there is none."""
        at = self.at.get(tag)
        return at[-1] if at else -1

    def cut(self, k: int) -> None:
        """Close everything from place k on."""
        while len(self.tags) > k:
            self.at[self.tags.pop()].pop()


class Tree(HTMLParser):
    """Nodes in page order; a node's parent comes before it. node: [parent, tag or None for text, families, chars, link chars, text, label].

    marks: read the training marks data-y; only for pages of our own.
    """

    def __init__(self, html: str, marks: bool = False):
        super().__init__(convert_charrefs=True)
        self.marks = marks
        # chars from the last end tag of what is dropped to the end of the page, once they are wanted
        self.ends: dict[str, int] | None = None
        self.read(html)
        if self.dropped.tags and self.dropped.tags[0] not in ("script", "style"):
            # an element without end tag took the rest of the page along: once more, without such elements
            self.ends = {m[1].lower(): len(html) - m.start() for m in END_OF_DROPPED.finditer(html)}
            self.reset()
            self.read(html)

    def read(self, html: str) -> None:
        self.nodes = [[-1, "root", frozenset(), 0, 0, None, None]]
        self.stack = [0]
        self.blocks = Open()  # tags of stack[1:]
        self.buf: list[str] = []
        self.linked = 0
        self.link = False
        self.dropped = Open()
        self.within = Open()  # blocks opened in what is dropped
        self.held: list[list] = []  # what came since the drop began: kind, tag or text, attributes, whether the tag drops nothing, self.left
        self.opens: list[list] = []  # those of it that self.dropped stands for
        self.left = len(html)  # chars from the tag in hand to the end
        self.endless = False  # no comment ends from here on
        self.feed(html)
        self.close()
        self.flush()

    def parse_html_declaration(self, i):
        # '<![' that is no CDATA section is a bogus comment up to '>', as in browsers; the parser's own check would end the page there
        if self.rawdata.startswith("<![", i) and not self.rawdata.startswith("<![CDATA[", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def parse_comment(self, i, report=1):
        k = -1 if self.endless else super().parse_comment(i, report)
        self.endless = k < 0
        return k

    def parse_starttag(self, i):
        self.left = len(self.rawdata) - i
        return super().parse_starttag(i)

    def flush(self):
        if self.buf:
            text = " ".join("".join(self.buf).split())
            if text:
                self.nodes.append([self.stack[-1], None, frozenset(), len(text), min(self.linked, len(text)), text, self.nodes[self.stack[-1]][6]])
            self.buf = []
        self.linked = 0

    def pop_to(self, tag, until=()):
        k = self.blocks.last(tag)
        if k >= 0 and all(self.blocks.last(t) < k for t in until):
            self.flush()
            self.blocks.cut(k)
            del self.stack[k + 1 :]

    def restore(self):
        """Nothing is dropped from here on."""
        self.dropped, self.within, self.held, self.opens = Open(), Open(), [], []

    def take_back(self):
        """What is being dropped has no end tag in its block: read what it held again, the open tags as if they weren't there.

        All open tags of a name are set aside at once, so that a stretch is read again once a name at most.
        """
        held, left = self.held, self.left
        for event in self.opens:
            event[3] = True
        self.restore()
        for kind, what, attrs, plain, self.left in held:
            if kind == "start":
                self.handle_starttag(what, attrs, plain)
            elif kind == "end":
                self.handle_endtag(what)
            else:
                self.handle_data(what)
        self.left = left

    def hold(self, kind, what, attrs=(), plain=False):
        if self.dropped.tags[0] not in ("head", "script", "style"):
            self.held.append([kind, what, attrs, plain, self.left])

    def handle_starttag(self, tag, attrs, plain=False):
        if self.dropped.tags:
            first = self.dropped.tags[0]
            if tag == "body" or self.dropped.tags == ["head"] and tag not in IN_HEAD:
                self.restore()
            else:
                self.hold("start", tag, attrs, plain)
                if tag == first and not plain or first == "head" and tag in ("title", "noscript", "script", "style", "template", "noframes"):
                    self.dropped.push(tag)
                    self.opens += self.held[-1:]
                elif tag in BLOCKS:
                    self.within.push(tag)
                return
        if tag in DROPPED:
            # scripts and styles run to the end of the page in browsers too, and a head ends by itself
            if not plain and (tag in ("head", "script", "style") or self.ends is None or 0 < self.ends.get(tag, 0) < self.left):
                self.dropped.push(tag)
                self.hold("start", tag, attrs)
                self.opens += self.held[-1:]
            return
        if tag == "a":
            self.link = True
        elif tag == "br" or tag == "hr":
            self.buf.append(" ")
        elif tag in BLOCKS:
            self.flush()
            self.link = False
            if tag in CLOSES_P:
                self.pop_to("p", ("table", "td", "th", "button", "div", "section", "article"))
            if tag in CLOSED_BY_SELF:
                self.pop_to(tag, CLOSED_BY_SELF[tag])
            named, label = set(), self.nodes[self.stack[-1]][6]
            for k, v in attrs:
                if k in ("class", "id", "role", "aria-label") and v:
                    named.update(WORDS[w] for w in LETTERS.findall(v.lower()) if w in WORDS)
                elif self.marks and k == "data-y":
                    label = int(v)
            self.nodes.append([self.stack[-1], tag, frozenset(named), 0, 0, None, label])
            self.stack.append(len(self.nodes) - 1)
            self.blocks.push(tag)

    def handle_startendtag(self, tag, attrs):
        if tag in VOID or tag not in DROPPED:
            self.handle_starttag(tag, attrs)
        elif tag in ("script", "style"):
            self.handle_starttag(tag, attrs)
            self.set_cdata_mode(tag)

    def handle_endtag(self, tag):
        if self.dropped.tags:
            for opened in (self.dropped, self.within):
                k = opened.last(tag)
                if k >= 0:
                    self.hold("end", tag)
                    opened.cut(k)
                    if opened is self.dropped:
                        del self.opens[k:]
                    if not self.dropped.tags:
                        self.restore()
                    return
            if tag not in BLOCKS or self.blocks.last(tag) < 0:
                self.hold("end", tag)
                return
            while self.dropped.tags:
                # a head, script or style without end is over with its block; the others give back what they held
                if self.dropped.tags[0] in ("head", "script", "style"):
                    self.restore()
                else:
                    self.take_back()
        if tag == "a":
            self.link = False
        elif tag in BLOCKS:
            self.pop_to(tag)

    def handle_data(self, data):
        if self.dropped.tags == ["head"] and data.strip():
            self.restore()
        if self.dropped.tags:
            self.hold("text", data)
        else:
            self.buf.append(data)
            if self.link:
                self.linked += len(data)


def totals(nodes) -> list[list[int]]:
    """Chars and link chars below each node."""
    t = [[x[3], x[4]] for x in nodes]
    for i in range(len(nodes) - 1, 0, -1):
        p = t[nodes[i][0]]
        p[0] += t[i][0]
        p[1] += t[i][1]
    return t


def features(node, below) -> tuple:
    """Names of a node's features."""
    chars, linked = below
    share = linked / chars if chars else 0
    links = "links:" + ("none" if share < 0.05 else "some" if share < 0.5 else "most")
    size = "size:" + str(min(6, int(math.log(chars + 1, 4))))
    if node[1] is None:
        return ("text", "text " + links, "text " + size)
    return ("element", "tag:" + node[1], links, *("class:" + f for f in sorted(node[2])))


def kind(node) -> str:
    """Which parent-child table holds for the node."""
    return "text" if node[1] is None else "turn" if node[1] in NEVER or node[1] in ("header",) or node[2] - {"text"} else "open" if node[1] in ("article", "main") or node[2] else "plain"


def semantic_labels(nodes) -> list[int]:
    """Weak labels: in article or main and not in an element or class that never holds content."""
    y = [0] * len(nodes)
    stop = [False] * len(nodes)
    for i, x in enumerate(nodes):
        if i:
            p = x[0]
            stop[i] = stop[p] or x[1] in NEVER or bool(x[2] & {"advert", "comment", "notice", "menu", "side"})
            y[i] = int(not stop[i] and (y[p] or x[1] in ("article", "main")))
    return y


# Pages labelled by hand: data-y marks a subtree as content (1) or not (0).
LABELLED = [
    '<body data-y=0><header class=site-header><a href=/>Home</a><p>Daily news for everyone</p></header><div class=cookie-notice><p>We use cookies to improve this site, accept them all?</p><button>OK</button></div><main data-y=1><h1>A long day at the harbour</h1><p>{p}</p><p>{p}</p><aside class=related data-y=0><h3>Related</h3><ul><li><a href=/1>Another story</a></li></ul></aside><p>{p}</p></main><footer><p>Copyright, all rights reserved.</p></footer></body>',
    '<body data-y=0><div id=nav><ul><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul></div><div id=content data-y=1><h2>Heading of it</h2><p>{p}</p><blockquote>{q}</blockquote><p>{p}</p><div class=advert data-y=0><p>{q}</p></div><p>{p}</p></div><div id=comments><h3>Comments</h3><div class=comment><p>{p}</p></div><div class=comment><p>{q}</p></div></div><form><label>Name</label><input><textarea></textarea></form></body>',
    '<body data-y=0><nav><a href=1>Start</a></nav><article data-y=1><header><h1>Title here</h1></header><p>{p}</p><ul><li>{q}</li><li>{q}</li></ul><table><tr><td>{q}</td><td>{q}</td></tr></table><form data-y=0><p>Subscribe to our letter by mail</p><button>Send</button></form><section class=comments data-y=0><p>{p}</p><p>{q}</p></section></article><aside><p>{p}</p></aside><footer>{q}</footer></body>',
    '<body data-y=0><div class=topbar><span>{q}</span></div><div class=wrapper><div class=sidebar><h4>About</h4><p>{p}</p></div><div class="post entry" data-y=1><h1>{q}</h1><p>{p}</p><pre>{q}</pre><div class=share data-y=0><a href=1>Tweet</a> <a href=2>Share</a></div><p>{p}</p></div></div><div class=footer><p>{p}</p></div></body>',
    '<body data-y=0><div class=banner><p>{p}</p></div><section class=story data-y=1><h2>{q}</h2><div><p>{p}</p><div><p>{p}</p></div></div></section><section class=newsletter><p>{p}</p></section><div class=popup><p>{q}</p></div></body>',
    '<body data-y=0><article data-y=1><h1>{q}</h1><p>{p}</p><div class="ad" data-y=0>{q}</div><p>{p}</p><nav data-y=0><a href=1>Next page</a></nav></article><div class="ad">{q}</div></body>',
    '<body data-y=0><table><tr><td class=menu><a href=1>Items</a><a href=2>More</a></td><td data-y=1><p>{p}</p><p>{p}</p></td></tr></table></body>',
    '<body data-y=0><div data-y=1><h1>{q}</h1><p>{p}</p><p>{p}</p><p>{p}</p></div><ul><li><a href=1>{q}</a></li><li><a href=2>{q}</a></li></ul><div class=legal><p>{p}</p></div></body>',
]
_Q = "Boats left early and came back late."
_P = "Nobody on the quay had expected the weather to turn so soon, and yet by noon the light was gone. " * 3


class Model:
    """Weights of features, and for each kind of child the log potentials [parent label][child label]."""

    def __init__(self, weights: dict, tables: dict):
        self.weights, self.tables = weights, tables

    def own(self, nodes) -> list[tuple]:
        return [features(x, b) for x, b in zip(nodes, totals(nodes))]

    def passes(self, nodes, own):
        """Log beliefs of labels 0 and 1, and each node's messages from below and to its parent: one pass up and one down."""
        n, w, known = len(nodes), self.weights, {}
        up0, up1 = [0.0] * n, []  # own potential and messages from children
        for f in own:
            if f not in known:
                known[f] = sum([w.get(x, 0.0) for x in f])
            up1.append(known[f])
        tables = [self.tables[kind(x)] for x in nodes]
        m0, m1 = [0.0] * n, [0.0] * n  # messages to the parent
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = tables[i]
            u0, u1, p = up0[i], up1[i], nodes[i][0]
            m0[i], m1[i] = _lse(a + u0, b + u1), _lse(c + u0, d + u1)
            up0[p] += m0[i]
            up1[p] += m1[i]
        b0, b1 = up0[:], up1[:]  # beliefs; parents come first
        for i in range(n):
            if i:
                (a, b), (c, d) = tables[i]
                p = nodes[i][0]
                q0, q1 = b0[p] - m0[i], b1[p] - m1[i]
                b0[i] += _lse(a + q0, c + q1)
                b1[i] += _lse(b + q0, d + q1)
            top = max(b0[i], b1[i])
            b0[i] -= top
            b1[i] -= top
        return b0, b1, up0, up1, m0, m1, tables

    def marginals(self, nodes) -> list[float]:
        """Probability of content of each node."""
        b0, b1, *_ = self.passes(nodes, self.own(nodes))
        return [_share(x, y) for x, y in zip(b0, b1)]

    def text(self, html: str | None) -> str:
        if not html:
            return ""
        nodes = Tree(html).nodes
        if len(nodes) == 1:
            return ""
        return " ".join([x[5] for x, p in zip(nodes, self.marginals(nodes)) if x[5] and p >= 0.5])


def _share(x: float, y: float) -> float:
    """exp(y) / (exp(x) + exp(y))"""
    return 1 / (1 + math.exp(min(700.0, x - y)))


def _lse(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


def train(labelled: list[tuple[list, list[int], float]], l2: float = 0.3, rounds: int = 40) -> Model:
    """Maximise the likelihood of the labels, whose gradient is observed less expected counts, both by sum-product.

    labelled: (nodes, labels, weight) of each page, a bounded list. Steps are resilient (sign-based, one size for each parameter).
    """
    kinds = ("text", "turn", "open", "plain")
    model = Model({}, {k: ((0.0, 0.0), (0.0, 0.0)) for k in kinds})
    pages = [(nodes, y, weight, model.own(nodes), [kind(x) for x in nodes]) for nodes, y, weight in labelled]
    value: dict = {f: 0.0 for *_, own, _ in pages for fs in own for f in fs} | {(k, a, b): 0.0 for k in kinds for a in (0, 1) for b in (0, 1)}
    size, last = dict.fromkeys(value, 0.3), dict.fromkeys(value, 0.0)
    for _ in range(rounds):
        grad = {k: -l2 * v for k, v in value.items()}
        for nodes, y, weight, own, of in pages:
            b0, b1, up0, up1, m0, m1, tables = model.passes(nodes, own)
            for i, fs in enumerate(own):
                d = weight * (y[i] - _share(b0[i], b1[i]))
                for f in fs:
                    grad[f] += d
                if i:
                    p, t = nodes[i][0], tables[i]
                    q = (b0[p] - m0[i], b1[p] - m1[i])
                    e = [math.exp(max(-700.0, q[a] + t[a][b] + u[i] - max(q) - max(up0[i], up1[i]))) for a in (0, 1) for b, u in ((0, up0), (1, up1))]
                    all_e = sum(e) or 1.0
                    for z, (a, b) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
                        grad[of[i], a, b] -= weight * e[z] / all_e
                    grad[of[i], y[p], y[i]] += weight
        for k, g in grad.items():
            same = g * last[k]
            size[k] = min(2.0, size[k] * 1.2) if same > 0 else size[k] * 0.5 if same < 0 else size[k]
            last[k] = g if same >= 0 else 0.0
            if same >= 0 and g:
                value[k] += math.copysign(size[k], g)
        model = Model({f: v for f, v in value.items() if isinstance(f, str)}, {k: ((value[k, 0, 0], value[k, 0, 1]), (value[k, 1, 0], value[k, 1, 1])) for k in kinds})
    return model


def fit(pages: DataFrame, fit_pages: int = FIT_PAGES) -> Model:
    """Train on the hand-labelled pages and fit_pages pages of the table at most."""
    ids = pages.filter("page_id is not null").filter(F.length("html") <= FIT_CHARS).select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(fit_pages)
    chosen = [r["page_id"] for r in ids.collect()]
    sample = pages.filter(F.col("page_id").isin(chosen)).filter(F.length("html") <= FIT_CHARS).groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id")
    labelled = []
    for page in LABELLED:
        nodes = Tree(page.replace("{p}", _P).replace("{q}", _Q), marks=True).nodes
        labelled.append((nodes, [x[6] or 0 for x in nodes], fit_pages / len(LABELLED)))
    for r in sample.collect() if chosen else []:
        nodes = Tree(r["html"]).nodes
        y = semantic_labels(nodes)
        if any(y):  # a page without semantic elements tells nothing
            labelled.append((nodes, y, 1.0))
    return train(labelled)


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each row, from its whole html."""
    schema = pages.select("page_id", "url").schema
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + ", text string, n_chars long"
    weights, tables = model.weights, model.tables

    def run(batches):
        m = Model(weights, tables)
        for batch in batches:
            texts = [m.text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, ddl)
