"""Clean text from documents with HTML, Markdown, wiki or LaTeX markup, whole or as leftovers (problem 2).

A scanner reads a text once from left to right: blocks whose inside does not count (code, formulas, comments, scripts,
styles) are taken out in the order they open, the rest is read line by line in the text's dialect. Wrapper inference by
aligning pages (module wrappers) finds what pages of one host share, but types nothing: it cannot tell a heading's repeated
group from a list's, and has no second page for most chunks. So elements come from the scanner; see the README.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Extensions of source code and configuration, and of documents.
SOURCE = {*"py ts tsx js jsx java go c cc cpp h hpp cs rs rb php swift kt scala clj sh bash zsh ps1 bat cmd sql css scss json yaml yml toml ini cfg conf env properties xml plist lock csv tsv r m lua pl proto gradle dockerfile makefile".split()}
DOCUMENT = {*"md mdx markdown html htm xhtml wiki mediawiki tex latex txt rst adoc text".split()}
TAGS = "a|abbr|article|aside|b|big|blockquote|body|br|button|caption|center|cite|code|col|colgroup|dd|del|details|div|dl|dt|em|figcaption|figure|font|footer|form|h[1-6]|head|header|hr|html|i|iframe|img|input|ins|kbd|label|li|link|main|mark|math|meta|mfrac|mi|mn|mo|mrow|msqrt|msub|msup|nav|nowiki|ol|option|p|pre|q|ref|s|samp|script|section|select|small|source|span|strike|strong|style|sub|summary|sup|svg|syntaxhighlight|table|tbody|td|textarea|tfoot|th|thead|time|title|tr|tt|u|ul|var|video|gallery|poem|includeonly|noinclude|references"

TAG = re.compile(rf"(?i)</?(?:{TAGS})(?:\s[^<>]*)?/?>|<!doctype[^>]*>")
ENTITY = re.compile(r"&(?:[A-Za-z][A-Za-z0-9]{1,30}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});")
_MATH_ENV = r"(?:equation|align|gather|multline|eqnarray|displaymath|math|flalign|alignat)"
BLOCK = re.compile(
    r"""(?isx)
    (?P<fence>^[ ]{0,3}(?P<mark>`{3,}|~{3,})(?P<info>[^\n`]*)(?:\n|\Z)(?P<fenced>.*?)(?:^[ ]{0,3}(?P=mark)(?:`|~)*[ \t]*\r?$|\Z))
    |(?P<pre><pre\b[^>]*>(?P<pre_in>.*?)(?:</pre\s*>|\Z))
    |(?P<source><(?P<tag>syntaxhighlight|source)\b[^>/]*>(?P<source_in>.*?)(?:</(?P=tag)\s*>|\Z))
    |(?P<verbatim>\\begin\{(?P<env>verbatim\*?|lstlisting|minted|alltt|Verbatim)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*(?P<verbatim_in>.*?)(?:\\end\{(?P=env)\}|\Z))
    |(?P<comment><!--.*?(?:-->|\Z))
    |(?P<script><(?P<st>script|style)\b[^>]*>.*?(?:</(?P=st)\s*>|\Z))
    |(?P<nowiki><nowiki>.*?</nowiki>)
    |(?P<html_math><math\b[^>]*>(?P<math_in>.*?)(?:</math\s*>|\Z))
    |(?P<math_env>\\begin\{(?P<menv>"""
    + _MATH_ENV
    + r"""\*?)\}(?P<math_env_in>.*?)\\end\{(?P=menv)\})
    |(?P<display>(?<!\\)\$\$(?P<display_in>(?:(?!\n[ \t]*\r?\n).)+?)\$\$|\\\[(?P<bracket_in>(?:(?!\n[ \t]*\r?\n).)+?)\\\])
    |(?P<paren>\\\((?P<paren_in>[^\n]+?)\\\))
    |(?P<code_tag><(?P<ct>code|tt|kbd|samp)\b[^>]*>(?P<code_in>(?:(?!<(?:/?p|/?li|pre)\b).)*?)</(?P=ct)\s*>)
    |(?P<tick>(?<![`\\])(?P<ticks>`{1,2})(?!`)(?P<tick_in>(?:(?!\n[ \t]*\r?\n).)+?)(?<!`)(?P=ticks)(?!`))
    |(?P<inline>(?<![\\$A-Za-z0-9])\$(?![\s$])(?P<inline_in>[^$\n]*?[^\s$\\])\$(?![\d$A-Za-z]))
    |(?P<tex_comment>(?<!\\)%[^\n]*)
    """,
    re.M,
)
#: Nothing of BLOCK can begin without one of these.
_OPENERS = re.compile(r"[`~$<%\\]")
HEADING = {
    "md": re.compile(r"^ {0,3}(?P<level>#{1,6})[ \t]+(?P<text>\S.*?)[ \t]*#*[ \t]*\r?$"),
    "wiki": re.compile(r"^(?P<level>={1,6})[ \t]*(?P<text>[^=\s].*?)[ \t]*=+[ \t]*\r?$"),
    "tex": re.compile(r"^\s*\\(?P<level>part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?\{(?P<text>.*?)\}"),
}
SETEXT = re.compile(r"^ {0,3}(?:=+|-+)[ \t]*\r?$")
ITEM = {
    "md": re.compile(r"^(?P<indent>[ \t]*)(?P<bullet>[-*+]|\d{1,9}[.)])[ \t]+(?P<text>\S.*)$"),
    "wiki": re.compile(r"^(?P<bullet>[*#]+)[ \t]*(?P<text>[^\s*#].*)$"),
    "tex": re.compile(r"^\s*\\item\b(?P<text>.*)$"),
}
RULE = re.compile(r"^ {0,3}(?:(?:-[ \t]*){3,}|(?:\*[ \t]*){3,}|(?:_[ \t]*){3,})\r?$")
HTML_HEADING = re.compile(r"(?is)<h(?P<level>[1-6])\b[^>]*>(?P<text>.*?)(?:</h[1-6]\s*>|(?=<h[1-6]\b)|\Z)")
HTML_ITEM = re.compile(r"(?i)<li\b[^>]*>")
TEX_WORD = re.compile(r"\\(?:part|chapter|(?:sub)*section|paragraph|begin|end|item|emph|text(?:bf|it|tt|sc|rm|sf|normal)?|label|ref|eqref|cite[tp]?|url|href|footnote|caption|usepackage|documentclass|newpage|clearpage|hspace|vspace|noindent|maketitle|includegraphics|newcommand|title|author|date|centering|underline|textsuperscript|hline|par|quad|qquad|LaTeX|TeX|ldots|dots|smallskip|medskip|bigskip|linebreak|pagebreak|tableofcontents|bibliography)\b\*?")
WIKI_MARK = re.compile(r"\[\[[^\[\]\n]+\]\]|'{2,5}[^'\n]+'{2,5}|^\{\||^\|[-}]|\{\{[^{}\n]+\}\}|\[https?://[^\s\]]+(?:\s[^\]\n]*)?\]|<ref\b|__(?:TOC|NOTOC|FORCETOC)__|^={2,6}[^=\n]+={2,6}\s*$|<syntaxhighlight", re.M)
MD_MARK = re.compile(r"!?\[[^\[\]\n]*\]\([^()\s]+(?:\s\"[^\"]*\")?\)|\*\*(?=\S)[^*\n]+?\S?\*\*|(?<![\w_])__(?=\S)[^_\n]+?__(?![\w_])|(?<![\w*])\*(?=[^\s*])[^*\n]*?[^\s*]\*(?![\w*])|~~(?=\S)[^~\n]+~~|^ {0,3}>[ \t]?\S|^\|?[ \t]*:?-{3,}:?[ \t]*\|[-:| \t]*\r?$|^ {0,3}\[[^\]\n]+\]:[ \t]*\S+|<https?://[^>\s]+>|(?<![\w_])_(?=[^\s_])[^_\n]*?[^\s_]_(?![\w_])", re.M)
#: Marks that stand alone in plain text.
LEFTOVER = re.compile(r"(?<!\S)(?:\*{2,3}|_{2,3}|~~|`{1,3}|'{2,5}|\[\[|\]\]|\{\{|\}\}|\{\||\|\}|#{2,6}|={2,6}(?=\s*$))(?!\S)|\[\[|\]\]|\{\{|\}\}", re.M)
WIKI_LIST_RUN = re.compile(r"^[*#]{1,4}[^\s*#=].*$|^#+[ \t]?\S.*\r?\n#+[ \t]?\S", re.M)
_CODE_LINE = re.compile(r"^\s*(?:(?:def|class|import|from|const|let|var|func|package|public|private|protected|interface|type|struct|return|export|function|elif|else|for|while|if|try|switch|case|fn|use|impl|namespace|using|local|echo|done|fi|SELECT|INSERT|UPDATE|DELETE|CREATE|ALTER|FROM|WHERE)\b.*|.*[{};]\s*|[}\])]+[;,]?|@\w+.*|\"[\w.-]+\"\s*:.*|[A-Za-z_][\w.\-\[\]\"']*\s*[:=]\s*\S.*|\[[\w.\- ]+\]|//.*|/\*.*|\s\*.*|--\s.*)\s*$")


def extension(path: str | None) -> str:
    name = (path or "").rsplit("/", 1)[-1].lower()
    return name.rsplit(".", 1)[1].split(":")[0].strip() if "." in name else name


def is_source(text: str, path: str | None) -> bool:
    """Whether a content is itself source code or configuration: by its file's extension, else by most of its lines."""
    ext = extension(path)
    if ext in SOURCE:
        return True
    if ext in DOCUMENT:
        return False
    lines = [x for x in text.splitlines() if x.strip()]
    return bool(lines) and sum(bool(_CODE_LINE.match(x)) for x in lines) > 0.6 * len(lines) and not (TAG.search(text) or TEX_WORD.search(text) or re.search(r"^(?:```|~~~)", text, re.M))


def dialect(text: str, path: str | None) -> str:
    ext = extension(path)
    if ext in ("wiki", "mediawiki"):
        return "wiki"
    if ext in ("tex", "latex"):
        return "tex"
    if ext in ("md", "mdx", "markdown", "html", "htm", "xhtml"):
        return "md"
    if re.search(r"\\(?:begin|section|subsection|subsubsection|chapter|item|texttt|textbf|emph)\b", text) and len(TEX_WORD.findall(text)) >= len(MD_MARK.findall(text)):
        return "tex"
    wiki = len(WIKI_MARK.findall(text)) + 2 * len(WIKI_LIST_RUN.findall(text))
    md = len(MD_MARK.findall(text)) + len(re.findall(r"^(?:[-+]|\d+[.)])[ \t]+\S|^(?:`{3,}|~{3,})|^#{1,6}[ \t].*#+[ \t]*\r?$", text, re.M))
    return "wiki" if wiki > md else "md"


class Parsed:
    """elements: (kind, level, text) in order; text: the clean text; any: whether the content holds markup at all."""

    __slots__ = ("any", "elements", "text")

    def __init__(self) -> None:
        self.elements: list[tuple[str, int, str]] = []
        self.text = ""
        self.any = False


_PUT = re.compile("\ue000(\\d+)\ue001")
#: Tags that end the item or paragraph before them.
_BREAK = re.compile(r"(?i)(?P<lead>\ue002\s*)?</?(?:p|div|ul|ol|dl|dt|dd|table|thead|tbody|tr|td|th|caption|blockquote|section|article|header|footer|main|nav|figure|details|summary)\b(?:\s[^<>]*)?/?>")


def _inline(s: str, kind: str) -> str:
    """A line's text without inline markup."""
    s = re.sub(r"(?i)<br\s*/?>", "\n", s)
    s = TAG.sub("", s)
    if kind == "wiki":
        s = re.sub(r"\[\[(?:[^|\[\]\n]*\|)*([^|\[\]\n]+)\]\]", r"\1", s)
        s = re.sub(r"\[https?://\S+?(?:\s([^\]\n]*))?\]", lambda m: m[1] or "", s)
        s = re.sub(r"'{2,5}", "", s)
        s = re.sub(r"\{\{[^{}\n]*\}\}", "", s)
    elif kind == "tex":
        s = re.sub(r"~?\\(?:label|ref|eqref|cite[tp]?|newpage|clearpage|hspace|vspace|noindent|pagebreak|linebreak)\b\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})?", "", s)
        s = re.sub(r"\\(?:begin|end)\{[^{}\n]*\}(?:\[[^\]\n]*\])?", "", s)
        for _ in range(3):
            s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}\n]*)\}", r"\1", s)
        s = re.sub(r"\\([%&$#_{}])", r"\1", s).replace("~", " ")
    s = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s\"[^\"]*\")?\)", r"\1", s)
    for p in (r"\*\*(?=\S)([^*\n]+?)\*\*", r"(?<![\w_])__(?=\S)([^_\n]+?)__(?![\w_])", r"~~(?=\S)([^~\n]+)~~", r"(?<![\w*])\*(?=[^\s*])([^*\n]*?[^\s*])\*(?![\w*])", r"(?<![\w_])_(?=[^\s_])([^_\n]*?[^\s_])_(?![\w_])"):
        s = re.sub(p, r"\1", s)
    s = LEFTOVER.sub("", s)
    return html.unescape(s)


def parse(text: str, path: str | None = None) -> Parsed:
    """Elements and clean text of a content; source code and configuration are passed on unread."""
    out = Parsed()
    if not text or is_source(text, path):
        out.text = text
        return out
    kind = dialect(text, path)
    held: list[tuple[str, int, str]] = []  # what stands for each taken-out block: element kind, level, clean text

    def take(m: re.Match) -> str:
        g = m.lastgroup
        # lastgroup is the outermost named group that matched last; ask by name instead
        for name in ("fence", "pre", "source", "verbatim"):
            if m[name] is not None:
                out.any = True
                inner = m[{"fence": "fenced", "pre": "pre_in", "source": "source_in", "verbatim": "verbatim_in"}[name]] or ""
                if name in ("pre", "source"):
                    inner = html.unescape(re.sub(r"(?i)^\s*<code\b[^>]*>|</code\s*>\s*$", "", inner)) if name == "pre" else inner
                held.append(("code_block", 0, inner.strip("\r\n")))
                return f"\n\ue000{len(held) - 1}\ue001\n"
        for name, inner in (("html_math", "math_in"), ("math_env", "math_env_in"), ("display", None), ("paren", "paren_in"), ("inline", "inline_in")):
            if m[name] is not None:
                if name == "inline" and kind == "wiki":
                    return m[0]
                out.any = True
                body = (m[inner] if inner else m["display_in"] or m["bracket_in"]) or ""
                held.append(("formula", int(name in ("display", "math_env")), re.sub(r"\s+", " ", html.unescape(TAG.sub("", body))).strip()))
                return f"\ue000{len(held) - 1}\ue001"
        if m["comment"] is not None or m["script"] is not None:
            out.any = True
            return ""
        if m["tex_comment"] is not None:
            if kind != "tex":
                return m[0]
            out.any = True
            return ""
        if m["nowiki"] is not None:
            out.any = True
            held.append(("", 0, m["nowiki"][8:-9]))
            return f"\ue000{len(held) - 1}\ue001"
        if m["code_tag"] is not None or m["tick"] is not None:
            if m["tick"] is not None and kind == "tex":
                return m[0]
            out.any = True
            held.append(("", 0, html.unescape(m["code_in"] if m["code_tag"] is not None else m["tick_in"])))
            return f"\ue000{len(held) - 1}\ue001"
        return m[0] if g else m[0]

    clean = re.sub("[\ufeff\ue000-\ue003]", "", text)
    rest = BLOCK.sub(take, clean) if _OPENERS.search(clean) else clean

    def title(m: re.Match) -> str:
        out.any = True
        held.append(("heading", int(m["level"]), " ".join(_PUT.sub(lambda p: held[int(p[1])][2], _inline(m["text"], kind)).split())))
        return f"\n\ue000{len(held) - 1}\ue001\n"

    if "<" in rest:
        rest = HTML_HEADING.sub(title, rest)
        rest = re.sub(r"(?i)</li\s*>", "", rest)
        rest = HTML_ITEM.sub("\n\ue002", rest)
        out.any = out.any or bool(_BREAK.search(rest))
        # what follows begins a line, marked so that it isn't read as one that begins with Markdown
        rest = _BREAK.sub(lambda m: m["lead"] if m["lead"] is not None else "\n\ue003", rest)
    lines = rest.split("\n")
    done: list[str] = []
    levels = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
    if not out.any:
        out.any = bool(TAG.search(rest) or ENTITY.search(rest) or TEX_WORD.search(rest) or WIKI_MARK.search(rest) or MD_MARK.search(rest) or LEFTOVER.search(rest))

    def put(s: str) -> None:
        """A finished line, with the elements that stand in it."""
        for p in _PUT.finditer(s):
            e, level, t = held[int(p[1])]
            if e and (e, int(p[1])) not in seen:
                seen.add((e, int(p[1])))
                out.elements.append((e, level, t))
        done.append(s)

    def shown(s: str) -> str:
        """An element's text, with what was taken out of it put back."""
        return _PUT.sub(lambda p: held[int(p[1])][2], s)

    seen: set = set()
    i = 0
    while i < len(lines):
        line = lines[i]
        body = line.strip()
        if body.startswith("\ue003"):
            body = body.strip("\ue003 \t")
            t = _inline(body, kind)
            if t.strip() or _PUT.search(t):
                put(t.strip())
            i += 1
            continue
        if not body:
            done.append("")
            i += 1
            continue
        if body.startswith("\ue002"):
            out.any = True
            t = _inline(body[1:].strip(), kind)
            out.elements.append(("list_item", 0, shown(t)))
            put("- " + t)
            i += 1
            continue
        m = HEADING[kind].match(line)
        if m and not body.startswith("\ue000"):
            out.any = True
            level = levels[m["level"]] if kind == "tex" else len(m["level"])
            t = _inline(m["text"], kind)
            out.elements.append(("heading", level, shown(t)))
            put("#" * level + " " + t)
            i += 1
            continue
        if kind == "md" and i + 1 < len(lines) and SETEXT.match(lines[i + 1]) and not ITEM["md"].match(line) and not RULE.match(line) and not re.match(r"^[ \t]*[>|<]", line) and (i == 0 or not lines[i - 1].strip() or done and done[-1] == "") and "|" not in body:
            out.any = True
            level = 1 if "=" in lines[i + 1] else 2
            t = _inline(body, kind)
            out.elements.append(("heading", level, shown(t)))
            put("#" * level + " " + t)
            i += 2
            continue
        if kind == "md" and RULE.match(line):
            out.any = True
            i += 1
            continue
        m = ITEM[kind].match(line)
        if m is None and kind == "tex" and extension(path) not in ("tex", "latex"):
            m = ITEM["md"].match(line)
        if m and not (kind == "wiki" and re.match(r"^\*\*[^*\n]+\*\*", line)):
            out.any = True
            t = _inline(re.sub(r"^\[[ xX]\][ \t]+", "", m["text"].strip()), kind)
            out.elements.append(("list_item", 0, shown(t)))
            depth = len(m["bullet"]) - 1 if kind == "wiki" else len(m["indent"].expandtabs(4)) // 2 if "indent" in m.groupdict() else 0
            put("  " * depth + "- " + t)
            i += 1
            continue
        if kind == "wiki" and re.match(r"^(?:\{\||\|[-}+]?|!)", body):
            cells = [c.split("|")[-1].strip() for c in re.split(r"\|\||!!", re.sub(r"^(?:\{\|.*|\|[-}].*|\|\+?|!)", "", body)) if c.strip()]
            if cells:
                put(" | ".join(_inline(c, kind) for c in cells))
            i += 1
            continue
        t = _inline(re.sub(r"^[ \t]*(?:>[ \t]?)+|^:+(?=\ue000)" if kind != "tex" else r"^\s+", "", line), kind)
        if t.strip() or _PUT.search(t):
            put(t.rstrip())
        i += 1

    def back(p: re.Match) -> str:
        e, level, t = held[int(p[1])]
        if e == "code_block":
            return f"```\n{t}\n```"
        if e == "heading":
            return "#" * level + " " + t
        if e == "formula":
            return f"$${t}$$" if level else f"${t}$"
        return t

    if not out.any:
        out.text = text
        return out
    out.text = re.sub(r"\n{3,}", "\n\n", _PUT.sub(back, "\n".join(done)).replace("\ue002", "").replace("\ue003", "")).strip("\n")
    return out


def _each(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "file_path", "content").where("chunk_id is not null and content is not null")


def elements(chunks: DataFrame) -> DataFrame:
    """(chunk_id, element, element_no): `markup` 0 for each chunk that holds any, and its headings, list items, code blocks
    and formulas numbered from 1 in order. Null, empty and source contents give no row; rows of one chunk_id are one chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, names, numbers = [], [], []
            for i, (t, p) in enumerate(zip(b.column("content"), b.column("file_path"), strict=True)):
                got = parse(t.as_py(), p.as_py())
                if not got.any:
                    continue
                at.append(i)
                names.append("markup")
                numbers.append(0)
                count: dict[str, int] = {}
                for e, _, _ in got.elements:
                    count[e] = count.get(e, 0) + 1
                    at.append(i)
                    names.append(e)
                    numbers.append(count[e])
            if at:
                yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(pa.array(at)), pa.array(names), pa.array(numbers, pa.int32())], names=["chunk_id", "element", "element_no"])

    return _each(chunks).mapInArrow(run, "chunk_id string, element string, element_no int").distinct()


def clean_text(chunks: DataFrame, out: str = "clean_text") -> DataFrame:
    """chunks with column clean_text: headings as '# ' lines, items as '- ' lines, code blocks fenced, formulas between '$'.

    Null stays null; contents without markup, and source code, are passed on as they are. A column already called
    clean_text is replaced.
    """
    base = chunks.drop(out)
    target = base.withColumn(out, F.col("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [None if t.as_py() is None else parse(t.as_py(), p.as_py()).text for t, p in zip(b.column("content"), b.column("file_path"), strict=True)]
            at = b.schema.get_field_index(out)
            yield b.set_column(at, b.schema.field(at), pa.array(got, pa.string()))

    return target.mapInArrow(run, target.schema)
