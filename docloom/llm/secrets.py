"""Credentials in source code, configuration and the documentation that quotes them (problem 4).

1. Literals: every content is scanned for literals in the place of a credential (assigned to a credential's name, in an
   address or an authorization value, a private key block, or of a form that only tokens have), wherever it stands.
2. Owners: literals are counted corpus-wide by the files that hold them. A weak literal that a share of all files holds is a
   placeholder and is suppressed (placeholders() tells which).
3. Confirmed: the rare literals with the structure of a secret.
4. Re-scan: every content is scanned again for the confirmed values with an automaton. A value is only looked for in
   contents that hold its anchor (the hash of GRAM characters of it, wherever they stand), found by a fixed-size filter and an equality
   join, so no table of all secrets is sent around and an automaton is built per batch from what that batch may hold.

Redaction replaces the values, nothing else; quotes, line ends and positions of other code stay.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._text import codepoints, scan_rows, sliding_hash

#: A weak literal in more than this share of all files, and in more than so many, is a placeholder. As a file holds few
#: literals, the share also bounds how many placeholders there can be.
SHARE, SHARED_OWNERS = 0.001, 12
#: Placeholders that are sent to all tasks; beyond it they are joined.
MOST_SENT = 100_000
#: Length from which a value can be strong, and characters of an anchor: no confirmed value is shorter.
RESCAN_LENGTH, GRAM = 12, 8
#: The filter of anchors has 2 ** FILTER_BITS bits (8 MB); with many anchors it lets more through.
FILTER_BITS = 26
#: Places of the further pieces of a value.
MORE = "array<struct<start:int,end:int>>"

_NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|secret|access|signing|encryption|private|auth|service|client|master|account|shared|session|webhook|license)[_\-. ]?key(?:[_\-. ]?id)?)"
_VALUE = r"""(?P<q>"{3}|'{3}|["'`])(?P<quoted>(?:\\.|(?!(?P=q))[^\n])*?)(?P=q)"""
#: A name, what may close it, a separator (with a line break or bracket before the value) and the value.
ASSIGNED = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?P<name>(?:[A-Za-z][A-Za-z0-9]*[_\-.])*[A-Za-z0-9]*?" + _NAME + r")(?:[._]0|\[0\])?(?![A-Za-z0-9_\-])"
    r"""(?:["'`\])]|&quot;)*(?:\s*:\s*(?:string|str|String)\b|[ \t]+string\b)?"""
    r"(?:[ \t]*(?:=>|:=|=(?!=)|:(?!:)|,|\|\||\?\?)[ \t]*|[ \t]+was[ \t]+|[ \t]+is[ \t]+(?=[\"'`])|[ \t]+(?=[\"'`])|(?<=password)[ \t]+)"
    r"""(?:[|>][-+]?[ \t]*(?=\r?\n)|\\(?=\r?\n))?(?:[(\[]?[ \t]*\r?\n[ \t]*(?:[#/]+[ \t]*)?|\([ \t]*)?(?:&quot;)?(?:[frbuFRBU](?=["']))?(?:\\(?="))?"""
    r"(?:" + _VALUE + r"|(?P<bare>[^\s\"'`,;(){}\[\]]+(?:\([^\s)]*\))?))"
)
ADDRESS = re.compile(r"(?i)\b[a-z][a-z0-9+.\-]{1,20}://(?P<user>[^\s/:@\"'`<>]*):(?P<v>[^\s/@\"'`]+)@(?=[A-Za-z0-9\[$%{<])")
HEADER = re.compile(r"(?i)\b(?P<scheme>bearer|basic|token|apikey)[ \t]+(?P<v>[A-Za-z0-9+/_=.~\-]{8,})")
PASSWORD_FLAG = re.compile(r"\b(?:mysql\w*|mariadb\w*|sshpass|redis-cli|docker|podman|mongo\w*|ldap\w*|smbclient)\b[^\n]*?\s(?:-p|-a|-w)[ =]?(?:'(?P<s>[^'\n]+)'|\"(?P<d>[^\"\n]+)\"|(?P<b>[^\s'\"]+))")
USER_FLAG = re.compile(r"(?:^|\s)(?:-u|--user)[ =][\"']?[A-Za-z0-9_.\-]+:(?P<v>[^\s\"'@]+)")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PRIVATE_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
#: Forms that only issued tokens have.
ISSUED = re.compile(r"(?<![A-Za-z0-9_\-])(?P<v>A(?:KI|SI)A[A-Z0-9]{16}|xox[abeoprs]-[A-Za-z0-9\-]{10,}|gl(?:pat|ptt|dt)-[A-Za-z0-9_\-]{16,}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|sk_live_[A-Za-z0-9]{6,}|rk_live_[A-Za-z0-9]{8,}|npm_[A-Za-z0-9]{30,}|AIza[A-Za-z0-9_\-]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|sk-(?:proj|svcacct|ant)-[A-Za-z0-9_\-]{20,}|hf_[A-Za-z0-9]{30,}|whsec_[A-Za-z0-9+/=]{24,}|eyJ[A-Za-z0-9_\-]{8,}\.eyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,})(?![A-Za-z0-9_])")
PIECE = re.compile(r"""[ \t]*(?:[+.\\&][ \t]*)?\r?\n[ \t]*(?:[#/*]+[ \t]*)?(?:[+.&][ \t]*)?(?P<q>["'`])(?P<v>[^"'`\n]+)(?P=q)(?![ \t]*:)|[ \t]*[+.&][ \t]*(?P<r>["'`])(?P<w>[^"'`\n]+)(?P=r)""")
NAMED_ENV = re.compile(r"(?i)\bname[\"']?\s*[:=]\s*[\"']?(?P<name>[A-Za-z0-9_\-.]*" + _NAME + r")[\"']?\s*,?[ \t]*\r?\n[ \t]*[\"']?value[\"']?\s*[:=][ \t]*(?:" + _VALUE + r"|(?P<bare>[^\s\"'`,]+))")

# How values that are left to be filled in, masked or kept elsewhere look.
_PLACEHOLDER = re.compile(
    r"(?ix)^(?: [*x.\#•_\-?]+ | .*\*{3,}.* | .*x{6,}.* | <.*>? | \$.* | .*\$\{.* | .*\{\{.* | \{.*\} | %\(.* | %[A-Za-z_]+% | @.* | \[.*\]? | \#\{.*"
    r" | (?:vault|file|env|ssm|aws-?sm|secret|secrets|keyring|op|arn|gcp|azure|kms|ref|from|config|data|https?)[:/].* | /.* | ~/.* | \./.*"
    r" | (?:to[_\- ]?be|your|enter|replace|change|put|insert|example|sample|dummy|fake|todo|tbd|fixme|redacted|masked|hidden|placeholder|fill|set|my|some|none|null|nil|undefined|true|false|yes|no|n/?a|default|test|testing|secret|password|passwd|token|unset|empty|required|optional|string|str|bytes|int|any|object|number|boolean|bool)(?:$|[_\- ][A-Za-z_\- ]*$|[_\-]?me\d*$|this$|in$)"
    r" | (?:os|process|env|environ|settings|config|conf|self|this|vault|secrets|ctx|args|opts|options|params|req|request|input|kwargs)\.[A-Za-z_.\[\]\"']+(?:\(.*)? )$"
)
_CODE = re.compile(r"^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*(?:\(|$)|[(){}<>]|=>|::|->")
_PUBLIC = re.compile(r"(?i)public")


def is_placeholder(v: str) -> bool:
    return len(v) < 4 or bool(_PLACEHOLDER.match(v)) or len(set(v)) <= 2


def entropy(v: str) -> float:
    n = len(v)
    return -sum(c / n * math.log2(c / n) for c in Counter(v).values())


def decoded(v: str) -> str | None:
    """Text that v is the base64 of, if it is."""
    if len(v) < 8 or len(v) % 4 or not re.fullmatch(r"[A-Za-z0-9+/]+={0,2}", v):
        return None
    try:
        text = base64.b64decode(v, validate=True).decode("utf-8")
    except (binascii.Error, UnicodeDecodeError):
        return None
    return text if text and all(32 <= ord(c) < 127 for c in text.rstrip("\n")) else None


def is_strong(v: str) -> bool:
    """Whether v has the structure of a generated secret."""
    kinds = sum(bool(re.search(p, v)) for p in ("[a-z]", "[A-Z]", "[0-9]", r"[^A-Za-z0-9]"))
    return len(v) >= RESCAN_LENGTH and bool(re.search("[0-9]", v) or (kinds >= 2 and len(v) >= 16)) and kinds >= 2 and entropy(v) >= 2.8


def _plausible(v: str, quoted: bool, name: str) -> bool:
    if is_placeholder(v) or _PUBLIC.search(name):
        return False
    text = decoded(v)
    if text is not None and (is_placeholder(text) or text.startswith("-----BEGIN CERT")):
        return False
    if re.fullmatch(r"[0-9.,:_\-]+", v) and len(v) < 10:
        return False
    has_digit = bool(re.search(r"[0-9]", v))
    if quoted:
        if " " in v.strip():
            return len(v.split()) <= 2 and has_digit
        return has_digit or len(v) >= 16 and bool(re.search("[a-z]", v) and re.search("[A-Z]", v)) or len(v) >= 8 and bool(re.search(r"[!@#%^&*~+=?]", v))
    if len(v) < 6 or _CODE.search(v) and not (has_digit and len(v) >= 12 and re.fullmatch(r"[\w.\-]+", v)):
        return len(v) >= 8 and has_digit and not re.search(r"[(){}<>\[\]]|::|->|=>", v) and not re.fullmatch(r"[a-z]+(?:_[a-z]+)+\d?", v)
    return has_digit or bool(re.search(r"[!@#%^&*~+=?]", v)) and len(v) >= 8


#: What any candidate's text must hold, of each pattern above; contents without it are left at once.
HINT = re.compile(
    r"(?i)pass|pwd|secret|token|credential|[a-z]key|[_\-. ]key|://[^\s/@]*:[^\s/]*@|bearer|basic[ \t]|-----BEGIN|(?:-u|--user)[ =]"
    r"|mysql|mariadb|redis-cli|docker|podman|mongo|ldap|smbclient"
    r"|AKIA|ASIA|xox|gl(?:pat|ptt|dt)-|gh[opsur]_|github_pat_|[sr]k_live|npm_|AIza|SG\.|eyJ|sk-(?:proj|svcacct|ant)-|hf_|whsec_"
)


def literals(text: str) -> list[tuple[int, int, str, str, bool, list[tuple[int, int]]]]:
    """(start, end, value, kind, weak, more) of the literal credentials in a text, in order, without overlaps.

    weak: nothing but its place tells it from an ordinary word. A value written in several pieces is the joined one; start and
    end are those of its first piece, more has those of the others.
    """
    if not HINT.search(text):
        return []
    found: list[tuple[int, int, str, str]] = []
    pieces: dict[tuple[int, int, str], list[tuple[int, int]]] = {}
    for m in PRIVATE.finditer(text):
        end = PRIVATE_END.search(text, m.end())
        stop = end.end() if end else len(text)
        body = re.sub(r"\\n|[^A-Za-z0-9+/=]", "", text[m.end() : end.start() if end else stop])
        if len(body) >= 16 and len(set(body)) > 8:
            found.append((m.start(), stop, text[m.start() : stop], "private_key"))
    for m in ADDRESS.finditer(text):
        v = m["v"]
        if not is_placeholder(v) and v.lower() not in (m["user"].lower(), "pass", "password", "pwd"):
            found.append((m.start("v"), m.end("v"), v, "address"))
    for m in HEADER.finditer(text):
        v = m["v"].rstrip(".")
        if m["scheme"].lower() == "basic":
            inner = decoded(v)
            ok = inner is not None and ":" in inner and not is_placeholder(inner.split(":", 1)[1])
        else:
            ok = not is_placeholder(v) and bool(re.search("[0-9]", v)) and len(v) >= 10 and not re.fullmatch(r"[a-z]+[0-9]{1,3}", v)
        if ok:
            found.append((m.start("v"), m.start("v") + len(v), v, "authorization"))
    for m in USER_FLAG.finditer(text):
        if not is_placeholder(m["v"]) and re.search("[0-9]", m["v"]):
            found.append((m.start("v"), m.end("v"), m["v"], "command"))
    for m in PASSWORD_FLAG.finditer(text):
        g = m.lastgroup or "b"
        if _plausible(m[g], g != "b", "password"):
            found.append((m.start(g), m.end(g), m[g], "command"))
    for m in ISSUED.finditer(text):
        if not is_placeholder(m["v"]):
            found.append((m.start("v"), m.end("v"), m["v"], "issued"))
    for pattern in (ASSIGNED, NAMED_ENV):
        at = 0
        while m := pattern.search(text, at):
            g = "quoted" if m["quoted"] is not None else "bare"
            v, a, b = m[g], m.start(g), m.end(g)
            at = max(m.end("name"), m.start() + 1)
            if g == "bare":
                w = v.rstrip(".:")
                b -= len(v) - len(w)
                v = w
            else:
                v = v.rstrip("\\")
            whole, more = _joined(text, v, b + len(m["q"])) if g == "quoted" else (v, [])
            if "://" in v or "PRIVATE KEY" in v or v.lower().startswith(("bearer ", "basic ")):
                continue
            if _plausible(whole, g == "quoted", m["name"]):
                form = next((f[3] for f in found if f[:2] == (a, a + len(v))), "assigned") if more else "assigned"
                found.append((a, a + len(v), whole, form))
                if more:
                    pieces[a, a + len(v), whole] = more
    found.sort(key=lambda x: (x[0], -x[1], x[:3] not in pieces))
    out: list[tuple[int, int, str, str, bool, list[tuple[int, int]]]] = []
    for a, b, v, kind in found:
        if out and a < out[-1][1]:
            continue
        out.append((a, b, v, kind, kind in ("assigned", "address", "command") and not is_strong(v), pieces.get((a, b, v), [])))
    return out


def _joined(text: str, first: str, end: int) -> tuple[str, list[tuple[int, int]]]:
    """(a value whose first piece closes before end, with all its pieces; places of the others)."""
    more = []
    while m := PIECE.match(text, end):
        g = "v" if m["v"] is not None else "w"
        first, end = first + m[g], m.end()
        more.append(m.span(g))
    return first, more


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every run of GRAM characters, offsets of the texts)."""
    cp, off = codepoints(texts)
    h, at = sliding_hash(cp.astype(np.uint64), off, GRAM)
    return h.view(np.int64), at


def anchor_of(v: str) -> int | None:
    """The gram a value is looked up by, the one of most different characters and digits; None if v is shorter than a gram."""
    if len(v) < GRAM:
        return None
    best = max(range(len(v) - GRAM + 1), key=lambda i: len(set(v[i : i + GRAM])) + sum(c.isdigit() for c in v[i : i + GRAM]))
    return int(grams(pa.array([v[best : best + GRAM]]))[0][0])


def line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _rows(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", "file_path", "content").where("chunk_id is not null and content is not null")


def candidates(chunks: DataFrame) -> DataFrame:
    """(chunk_id, file_path, line_no, start, end, value, kind, weak, more, sought) of every literal credential by its place or form.

    more: places of further pieces. sought: what the second scan looks for, (text, rest, anchor); rest is what follows text in
    further pieces.
    """

    def looked_for(v: str, first: str) -> list[tuple[str, str | None, int]]:
        parts = [(v, None), *([(first, v[len(first) :])] if first != v and is_strong(first) else [])]
        return [(t, r, k) for t, r in parts if (k := anchor_of(t)) is not None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, out = [], []
            for i, t in enumerate(b.column("content")):
                text = t.as_py()
                for a, e, v, kind, weak, more in literals(text):
                    at.append(i)
                    out.append((line_of(text, a), a, e, v, kind, weak, more, [] if weak or kind == "private_key" else looked_for(v, text[a:e])))
            if out:
                cols = list(zip(*out, strict=True))
                take = pa.array(at)
                sought = pa.list_(pa.struct([("text", pa.string()), ("rest", pa.string()), ("anchor", pa.int64())]))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), sought)
                yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(take), b.column("file_path").take(take), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=["chunk_id", "file_path", "line_no", "start", "end", "value", "kind", "weak", "more", "sought"])

    return _rows(chunks).mapInArrow(run, f"chunk_id string, file_path string, line_no int, start int, end int, value string, kind string, weak boolean, more {MORE}, sought array<struct<text:string,rest:string,anchor:long>>")


def placeholders(found: DataFrame, files: int, share: float = SHARE, least: int = SHARED_OWNERS) -> DataFrame:
    """(value, owners): weak literals of candidates() that more than the share of all files, and more than least, hold.

    At most 1 / share times the literals of an average file can be.
    """
    # a placeholder that a third of all files share is one row per task before it is shuffled
    owners = found.where("weak").select("value", "file_path").distinct().groupBy("value").agg(F.count("*").alias("owners"))
    return owners.where(F.col("owners") > max(least, share * files))


def find_secrets(chunks: DataFrame, share: float = SHARE, least: int = SHARED_OWNERS) -> DataFrame:
    """(chunk_id, line_no, start, end, value, kind, more): every place of a credential, one row per place.

    A value written in several pieces is one row: start and end of the first piece, the others in more.

    Lines count from 1, positions are code points from 0. Null contents and ids give no row; rows of one chunk_id are one
    chunk. kind is private_key, address, authorization, command, issued, assigned, or rescan for places that only the
    second scan finds. share, least: see placeholders().
    """
    found = candidates(chunks).persist()
    files = chunks.select("file_path").distinct().count()
    common = placeholders(found, files, share, least).select("value").persist()
    common = F.broadcast(common) if common.count() <= MOST_SENT else common
    places = found.join(common.withColumn("common", F.lit(True)), "value", "left").where(~(F.col("weak") & F.coalesce("common", F.lit(False)))).drop("common")
    first = places.select("chunk_id", "line_no", "start", "end", "value", "kind", "more").distinct()

    confirmed = places.select(F.explode("sought").alias("x")).select("x.*").distinct()
    again = _rescan(chunks, confirmed)
    extra = again.join(first.select("chunk_id", "start"), ["chunk_id", "start"], "left_anti")
    # places inside a place already found (a longer literal, a key block) are not new
    spans = _spans(first).select("chunk_id", F.col("start").alias("s"), F.col("end").alias("e"))
    extra = extra.join(spans, (extra["chunk_id"] == spans["chunk_id"]) & (F.col("start") < F.col("e")) & (F.col("end") > F.col("s")), "left_anti")
    return first.unionByName(extra.select("chunk_id", "line_no", "start", "end", "value", F.lit("rescan").alias("kind"), "more"))


def _spans(places: DataFrame) -> DataFrame:
    """(chunk_id, start, end, kind) of every piece at places."""
    one = places.select("chunk_id", "start", "end", "kind")
    return one.unionByName(places.select("chunk_id", F.explode("more").alias("m"), "kind").select("chunk_id", "m.start", "m.end", "kind")) if "more" in places.columns else one


def _rescan(chunks: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(chunk_id, line_no, start, end, value, more): places of confirmed values (text, rest, anchor) in all contents."""

    bits = 1 << FILTER_BITS
    place = F.pmod(F.col("anchor"), F.lit(bits))
    words = confirmed.groupBy((place / 64).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(anchor, 64) as int)))").alias("m")).toPandas()
    maybe = np.zeros(bits // 64, np.int64)
    maybe[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    sent_filter = chunks.sparkSession.sparkContext.broadcast(maybe)

    def held_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent_filter.value
        for batch in batches:
            for b in scan_rows(batch, "content"):
                h, off = grams(b.column("content"))
                at = h & (bits - 1)
                hit = np.flatnonzero((wanted[at >> 6] >> (at & 63)) & 1)
                if len(hit):
                    row = np.searchsorted(off, hit, side="right") - 1
                    row, anchor = np.unique(np.stack([row, h[hit]]), axis=1)
                    yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(pa.array(row)), pa.array(anchor)], names=["chunk_id", "anchor"])

    held = _rows(chunks).mapInArrow(held_grams, "chunk_id string, anchor long")
    # few contents hold an anchor: what is joined back to the contents is those, with the values to look for
    wanted = held.join(confirmed, "anchor").groupBy("chunk_id").agg(F.collect_set(F.struct("text", "rest")).alias("wanted"))
    rows = _rows(chunks).select("chunk_id", "content").join(wanted, "chunk_id")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        for pdf in batches:
            auto = ahocorasick.Automaton()
            rests: dict[str, set[str]] = {}
            for w in (x for w in pdf["wanted"] for x in w):
                rests.setdefault(w["text"], set()).update([w["rest"]] if w["rest"] else [])
            for v in rests:
                auto.add_word(v, v)
            out = []
            if len(auto):
                auto.make_automaton()
                for cid, text in zip(pdf["chunk_id"], pdf["content"], strict=True):
                    last = -1
                    for end, v in auto.iter_long(text):
                        a = end - len(v) + 1
                        if a > last:
                            whole, more = _joined(text, v, end + 2) if rests[v] and text[end + 1 : end + 2] in ("'", '"', "`") else (v, [])
                            if whole[len(v) :] not in rests[v]:
                                whole, more = v, []
                            out.append((cid, line_of(text, a), a, end + 1, whole, [{"start": s, "end": e} for s, e in more]))
                            last = end
            yield pd.DataFrame(out, columns=["chunk_id", "line_no", "start", "end", "value", "more"])

    return rows.mapInPandas(scan, f"chunk_id string, line_no int, start int, end int, value string, more {MORE}").distinct()


def redact(chunks: DataFrame, places: DataFrame, mask: str = "[REDACTED]") -> DataFrame:
    """chunks, one row per row, with column redacted_content: content with the values at places replaced by mask.

    Contents without a place, and null contents, are passed on as they are. A private key keeps its first and last line.
    """
    by_chunk = _spans(places).groupBy("chunk_id").agg(F.sort_array(F.collect_set(F.struct("start", "end", "kind"))).alias("places"))
    base = chunks.drop("redacted_content", "places")
    joined = base.join(by_chunk, "chunk_id", "left")

    @F.pandas_udf("string")
    def cut(content: pd.Series, where: pd.Series) -> pd.Series:
        out = []
        for text, spans in zip(content, where, strict=True):
            if text is None or spans is None:
                out.append(text)
                continue
            parts, at = [], 0
            for s in spans:
                if s["start"] < at:
                    continue
                old = text[s["start"] : s["end"]]
                if s["kind"] == "private_key":
                    head, tail = PRIVATE.match(old), PRIVATE_END.search(old)
                    new = old[: head.end()] + mask + (old[tail.start() :] if tail else "")
                else:
                    new = mask
                parts += [text[at : s["start"]], new]
                at = s["end"]
            out.append("".join(parts) + text[at:])
        return pd.Series(out, dtype=object)

    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    masked = F.when(F.col("places").isNull(), F.col("content")).otherwise(cut("content", F.coalesce("places", none)))
    return joined.withColumn("redacted_content", masked).drop("places")
