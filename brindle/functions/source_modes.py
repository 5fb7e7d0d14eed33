"""Source reduction by mode: full, minimal, pseudo, structure, signatures, types. Works on one text; run in Arrow batches.

There is no grammar for most languages here, so a lexer marks comments and strings, and blocks are found by braces (by
indentation in Python and Ruby). What opens a block decides what it is: a callable, a type, or neither.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions import serde

BODY = " {...}"
MAX_BYTES, MAX_BLOCKS = 5 << 20, 100_000
BRACES = ("typescript", "javascript", "rust", "go", "java", "c", "cpp", "csharp", "kotlin", "swift", "bash")
HASHES = ("python", "ruby", "bash")
CALLS = r"(?:\b(?:fn|func|function|fun|init|deinit|constructor)\b|\)|=>\s*$)"
CONTROL = r"^\s*(?:\}\s*)?(?:if|else|for|foreach|while|do|switch|match|try|catch|finally|loop|select|when|with|unsafe|synchronized|guard|defer|return|new|case|using|lock|fixed|async\s+move)\b"
TYPES = r"\b(?:class|struct|enum|interface|trait|union|protocol|record|object|typealias|type)\s+[A-Za-z_]"
HOLDERS = r"\b(?:impl|mod|namespace|module|extension|extern|package|companion)\b"
DOC = {
    "typescript": ("/**",), "javascript": ("/**",), "java": ("/**",), "kotlin": ("/**",), "rust": ("///", "//!", "/**", "/*!"), "c": ("/**", "///"), "cpp": ("/**", "///"), "csharp": ("///", "/**"), "swift": ("///", "/**"),
}


@cache
def _lexer(lang: str) -> re.Pattern:
    hashes = [r"(?P<comment>(?<![\w$\{])#[^\n]*)"] if lang in HASHES else [r"(?P<comment>--[^\n]*|/\*.*?(?:\*/|\Z))"] if lang == "sql" else [r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"]
    triple = [r'"""(?:\\.|(?!""").)*(?:"""|\Z)', r"'''(?:\\.|(?!''').)*(?:'''|\Z)"] if lang in ("python", "kotlin", "swift") else []
    raw = [r'r(?P<h>#*)".*?(?:"(?P=h)|\Z)', r"'(?:\\.|[^\\'\n])'"] if lang == "rust" else [r"'(?:\\.|[^'\\\n])*'"]
    ticks = [r"`(?:\\.|[^`\\])*`"] if lang in ("typescript", "javascript", "go", "bash") else []
    strings = "|".join([*triple, *raw, r'"(?:\\.|[^"\\\n])*"', *ticks])
    return re.compile("|".join([*hashes, f"(?P<string>{strings})"]), re.S)


def tokens(text: str, lang: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of comments and strings, in order."""
    return [(m.start(), m.end(), "comment" if m.group("comment") is not None else "string") for m in _lexer(lang).finditer(text)]


def masked(text: str, lang: str, kinds: tuple[str, ...] = ("comment", "string")) -> str:
    """The text with what those tokens hold replaced by blanks; line ends stay, so offsets do too."""
    out, at = [], 0
    for a, b, kind in tokens(text, lang):
        if kind in kinds:
            out += [text[at:a], re.sub(r"[^\n]", " ", text[a:b])]
            at = b
    return "".join(out) + text[at:]


def blocks(text: str, lang: str) -> list[tuple[int, int, int, str]]:
    """(head_start, open, end, kind) of outermost-first blocks; kind is callable, type, holder or other."""
    return _indented(text, lang) if lang in ("python", "ruby") else _braced(text, lang)


def _kind(head: str, inside: str | None) -> str:
    if re.match(CONTROL, head):
        return "other"
    if re.search(TYPES, head) and not re.search(r"\b(?:fn|func|function|fun)\b", head):
        return "type"
    if re.search(HOLDERS, head) and not re.search(r"\bfn\b", head):
        return "holder"
    if inside == "callable" and not re.search(r"\b(?:fn|func|function|fun)\b|=>", head):
        return "other"
    return "callable" if re.search(CALLS, head) else "other"


def _braced(text: str, lang: str) -> list[tuple[int, int, int, str]]:
    m, out, stack, start, round_ = masked(text, lang), [], [], 0, 0
    for hit in re.finditer(r"[{};()]", m):
        c, i = hit.group(), hit.start()
        if c in "()":
            round_ = max(0, round_ + (1 if c == "(" else -1))
        elif c == "{":
            head = start + len(m[start:i]) - len(m[start:i].lstrip())
            stack.append((head, i, _kind(m[head:i], stack[-1][2] if stack else None), len(out), round_))
            out.append(None)
            start, round_ = i + 1, 0
        elif c == "}":
            if stack:
                head, opened, kind, k, round_ = stack.pop()
                out[k] = (head, opened, i + 1, kind)
            start = i + 1
        elif round_ == 0:
            start = i + 1
        if len(out) > MAX_BLOCKS:
            break
    while stack:
        head, opened, kind, k, _ = stack.pop()
        out[k] = (head, opened, len(text), kind)
    return out


def _indented(text: str, lang: str) -> list[tuple[int, int, int, str]]:
    """Blocks of ``def`` and ``class`` lines: what stands deeper than their line, and in Ruby the ``end`` that closes them."""
    m, lines, at = masked(text, lang), [], 0
    for line in m.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    out = []
    for n, (a, line) in enumerate(lines):
        d = re.match(r"([ \t]*)(?:async[ \t]+)?(def|class|module)\b", line)
        if not d or (d.group(2) == "module" and lang == "python"):
            continue
        depth, k = len(d.group(1).expandtabs()), n
        if lang == "python":  # a head may go on over lines until its brackets close
            head = line
            while head.count("(") + head.count("[") > head.count(")") + head.count("]") and k + 1 < len(lines):
                k += 1
                head += lines[k][1]
        body, end, last = lines[k][0] + len(lines[k][1].rstrip()), lines[k][0] + len(lines[k][1].rstrip()), k
        if lang == "python" and not lines[k][1].rstrip().endswith(":"):
            inner = re.match(r"[^\n]*?:(?=\s*\S)", m[a:end].split("\n")[-1])
            body = lines[k][0] + (inner.end() if inner else len(lines[k][1].rstrip()))
        for j in range(k + 1, len(lines)):
            bare = lines[j][1].strip()
            if bare and len(re.match(r"[ \t]*", lines[j][1]).group().expandtabs()) <= depth:
                if lang == "ruby" and re.match(r"\s*end\b", lines[j][1]):
                    last = j
                break
            if bare or text[lines[j][0] : lines[j][0] + len(lines[j][1])].strip():
                last = j
        end = max(end, lines[last][0] + len(lines[last][1].rstrip("\n"))) if last > k else end
        if last > k:
            end = lines[last][0] + len(text[lines[last][0] : lines[last][0] + len(lines[last][1])].rstrip())
        out.append((a + len(d.group(1)), body, end, {"def": "callable", "class": "type", "module": "holder"}[d.group(2)]))
    return out


def _outer(found: list[tuple[int, int, int, str]], kind: str) -> list[tuple[int, int, int, str]]:
    """Blocks of that kind that no other block of the kind holds."""
    out, end = [], -1
    for b in sorted(found):
        if b[3] == kind and b[0] >= end:
            out.append(b)
            end = b[2]
    return out


def structure(text: str, lang: str) -> str:
    """Bodies of callables become ``{...}``; everything else stays. Markdown keeps headings of levels 1 to 3."""
    if lang == "markdown":
        return "\n".join(h for _, h in headings(text, 3))
    out, at = [], 0
    for _, opened, end, _ in _outer(blocks(text, lang), "callable"):
        out += [text[at:opened].rstrip(), BODY]
        at = end
    return "".join(out) + text[at:]


def signatures(text: str, lang: str) -> str:
    """One signature a line, nested callables in types and holders too. Markdown keeps all headings."""
    if lang == "markdown":
        return "\n".join(h for _, h in headings(text, 6))
    heads = [text[a:b].strip().rstrip(":").strip() if lang == "python" else text[a:b].strip() for a, b, _, _ in _outer(blocks(text, lang), "callable")]
    return "\n".join(re.sub(r"\s*\n\s*", " ", h) for h in heads)


def types(text: str, lang: str) -> str:
    """Type definitions, whole but for the bodies of callables in them, and aliases. Markdown keeps all headings."""
    if lang == "markdown":
        return signatures(text, lang)
    if lang == "sql":
        return "\n".join(m.group().strip() for m in re.finditer(r"(?is)\bcreate\s+(?:or\s+replace\s+)?(?:table|type|view)\b.*?(?:;|\Z)", text))
    found = [(a, structure(text[a:e], lang)) for a, _, e, _ in _outer(blocks(text, lang), "type")]
    m = masked(text, lang)
    ends = [(b[0], b[2]) for b in _outer(blocks(text, lang), "type")]
    for hit in re.finditer(r"(?m)^[ \t]*(?:(?:pub(?:\([^)]*\))?|export|public|private|internal|declare)[ \t]+)*(?:type|typealias|typedef|using|struct)\b[^{;\n]*(?:;|$)", m):
        if not any(a <= hit.start() < e or a < hit.end() <= e for a, e in ends) and re.search(r"=|;|typedef", hit.group()):
            found.append((hit.start(), text[hit.start() : hit.end()].strip()))
    return "\n".join(t for _, t in sorted(found))


def minimal(text: str, lang: str) -> str:
    """Comments go, but for a shebang, doc comments and those inside callables; then blanks are tidied."""
    bodies = [(b, e) for _, b, e, k in blocks(text, lang) if k == "callable"] if lang in (*BRACES, "python", "ruby") else []
    bodies = sorted(bodies)
    m, out, at, k, reach = masked(text, lang, ("comment",)), [], 0, 0, -1
    for a, b, kind in tokens(text, lang):
        if kind != "comment":
            continue
        while k < len(bodies) and bodies[k][0] <= a:
            reach = max(reach, bodies[k][1])
            k += 1
        word = text[a:b]
        doc = any(word.startswith(p) for p in DOC.get(lang, ())) or (lang == "go" and _before_declaration(m, b))
        if (a == 0 and word.startswith("#!")) or a < reach or doc:
            continue
        line = text.rfind("\n", 0, a) + 1
        whole = not text[line:a].strip() and (b == len(text) or text[b] == "\n")
        out.append(text[at : line if whole else a])
        at = min(len(text), b + 1) if whole else b
    return tidy("".join(out) + text[at:])


def _before_declaration(blank: str, at: int) -> bool:
    """Go: nothing but comments (blank here) and single line ends between the comment and a declaration."""
    return re.match(r"[ \t]*\n(?:[ \t]+\n)*(?:func|type|var|const|package)\b", blank[at:]) is not None


def tidy(text: str) -> str:
    """Line ends trimmed, two blank lines at most in a row, a final line end kept."""
    return re.sub(r"\n{4,}", "\n\n\n", re.sub(r"[ \t\r]+(?=\n|\Z)", "", text))


def pseudo(text: str, lang: str) -> str:
    """Logic without ceremony: no decorators, attributes, terminating semicolons, non-visibility modifiers, generics of
    declarations or (Python, TypeScript) parameter types; return types and visibility stay."""
    text = minimal(text, lang)
    held: list[str] = []

    def hold(m: re.Match) -> str:
        held.append(m.group())
        return f"\x00{len(held) - 1}\x00"

    s = _lexer(lang).sub(hold, text.replace("\x00", ""))
    if lang in ("python", "java", "typescript", "kotlin", "swift", "csharp"):
        s = re.sub(r"(?m)^[ \t]*@[\w.]+(?:\([^()\n]*\))?[ \t]*\n", "", s)
        s = re.sub(r"(?m)^([ \t]*)(?:@[\w.]+(?:\([^()\n]*\))?[ \t]+)+", r"\1", s) if lang != "python" else s
    if lang == "rust":
        s = re.sub(r"(?m)^[ \t]*#!?\[[^\n]*\][ \t]*\n", "", s)
        s = re.sub(r"'[a-z_]\w*\s*(?=\w|\[|&)|\bmut\s+", "", s)
        s = re.sub(r"\s*\bwhere\b[^{;]*(?=[{;])", " ", s)
        s = re.sub(r"(\b(?:fn|struct|enum|trait|impl)\b\s*\w*)<[^<>]*(?:<[^<>]*>[^<>]*)*>", r"\1", s)
    if lang == "csharp":
        s = re.sub(r"(?m)^[ \t]*\[[A-Z][^\n]*\][ \t]*\n", "", s)
    if lang in ("java", "csharp", "kotlin", "swift", "cpp", "typescript"):
        s = re.sub(r"\b(?:static|final|abstract|readonly|override|sealed|virtual|inline" + ("|open" if lang == "kotlin" else "") + r")\s+(?=\w)", "", s)
    if lang in ("typescript", "java", "kotlin", "csharp", "swift", "cpp"):
        s = re.sub(r"(\b(?:class|interface|function|fun|func|struct|type)\s+\w+)<[^<>]*(?:<[^<>]*>[^<>]*)*>", r"\1", s)
    if lang in ("python", "typescript"):
        s = _untyped(s, lang)
    if lang not in ("python", "ruby", "bash", "sql"):
        s = re.sub(r"(?m);[ \t]*$", "", s)
    return tidy(re.sub("\x00(\\d+)\x00", lambda m: held[int(m.group(1))], s))


def _untyped(s: str, lang: str) -> str:
    """Parameter lists of declarations without ``: type`` and without ``self`` or ``cls``; defaults stay."""
    head = re.compile(r"\bdef\s+\w+\s*(\()" if lang == "python" else r"(?:\bfunction\s*\w*\s*|\b(?!if\b|for\b|while\b|switch\b|catch\b|return\b)\w+\s*)(\()(?=[^()]*\)\s*(?::[^{}\n]*)?(?:\{|=>))|(?<==\s)(\()(?=[^()]*\)\s*(?::[^{}\n=]*)?=>)")
    out, at = [], 0
    for m in head.finditer(s):
        opened = m.end()
        depth, i = 1, opened
        while i < len(s) and depth:
            depth += (s[i] in "([{") - (s[i] in ")]}")
            i += 1
        if opened < at or depth:
            continue
        params, level, last = [], 0, opened
        for j in range(opened, i):
            level += (s[j] in "([{<") - (s[j] in ")]}" or (s[j] == ">" and s[j - 1] != "="))
            if (s[j] == "," and level == 0) or j == i - 1:
                params.append(s[last:j])
                last = j + 1
        plain = [re.sub(r"^(\s*[*.\w]+)\s*\??\s*:[^=]*?(\s*=[^>].*)?$", r"\1\2", p, flags=re.S) for p in params]
        if lang == "python" and plain and plain[0].strip() in ("self", "cls"):
            plain = [p.lstrip() if n == 0 else p for n, p in enumerate(plain[1:])]
        out += [s[at:opened], ",".join(plain), ")"]
        at = i
    return "".join(out) + s[at:]


def headings(text: str, most: int) -> list[tuple[int, str]]:
    """(level, line) of headings up to that level, outside fences; underlined ones are levels 1 and 2."""
    out, fence, before = [], None, ""
    for line in text.splitlines():
        mark = re.match(r" {0,3}(```+|~~~+)", line)
        if fence:
            fence = None if mark and mark.group(1).startswith(fence) else fence
        elif mark:
            fence = mark.group(1)
        elif h := re.match(r" {0,3}(#{1,6})(?:[ \t]|$)", line):
            if len(h.group(1)) <= most:
                out.append((len(h.group(1)), line.strip()))
        elif (u := re.match(r" {0,3}(=+|-+)[ \t]*$", line)) and before.strip() and not re.match(r"[ \t]*([-*+>]|\d+[.)])[ \t]", before):
            level = 1 if u.group(1)[0] == "=" else 2
            if level <= most:
                out.append((level, f"{'#' * level} {before.strip()}"))
        before = "" if fence or mark else line
    return out


def transform(text: str | None, lang: str | None, mode: str) -> str | None:
    """The text in that mode. Null stays null; unknown languages and texts over MAX_BYTES are returned as they are; JSON, YAML
    and TOML give their keys in every mode but full and minimal."""
    if text is None or mode == "full" or lang is None or len(text) > MAX_BYTES:
        return text
    if lang in serde.STRUCTURES:
        return text if mode in ("minimal", "pseudo") else serde.STRUCTURES[lang](text)
    if lang == "markdown" and mode in ("minimal", "pseudo"):
        return tidy(text)
    return {"minimal": minimal, "pseudo": pseudo, "structure": structure, "signatures": signatures, "types": types}[mode](text, lang)


def transform_column(text: Column, lang: Column, mode: str) -> Column:
    @F.pandas_udf(StringType())
    def run(t: pd.Series, l: pd.Series) -> pd.Series:  # noqa: E741
        return pd.Series([transform(x, y, mode) for x, y in zip(t, l, strict=True)], dtype=object)

    return run(text, lang)


def symbols(text: str | None, lang: str | None) -> list[tuple[str, str]]:
    """(name, field) of a source's callables and types, in order: what relevance judgements are made from."""
    if not text or lang not in (*BRACES, "python", "ruby"):
        return []
    out = []
    for a, b, _, kind in sorted(blocks(text, lang)):
        head = text[a:b]
        if kind == "type" and (m := re.search(r"\b(?:class|struct|enum|interface|trait|union|protocol|record|object|type)\s+([A-Za-z_]\w*)", head)):
            out.append((m.group(1), "type_definition"))
        elif kind == "callable" and (m := re.search(r"\b(?:fn|func|function|fun|def)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)|([A-Za-z_]\w*)\s*\(", head)):
            out.append((m.group(1) or m.group(2), "function_signature"))
    return out
