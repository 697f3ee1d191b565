"""An offline stand-in for a model: a narrative about a program, scraped from its text."""

from __future__ import annotations

import re

# Names in a body that the narrative's calls leave out, and its phrases.
LEFT_OUT = ("print", "len", "range", "str", "int", "if", "for", "while")
OVERVIEW = "ADIM 1: GENEL BAKIŞ"
OVERVIEW_COUNTS = "Bu kod {} fonksiyon ve {} sınıf içermektedir."
FUNCTION_STEP = "ADIM {}: {} FONKSİYONU ANALİZİ"
FUNCTION_CALLS = "- {} fonksiyonu şu fonksiyonları çağırıyor: {}"
FUNCTION_NO_CALLS = "- {} fonksiyonu başka fonksiyon çağırmıyor"
FUNCTION_SEEN = "- {} fonksiyonu analiz edildi"
CLASS_STEP = "ADIM {}: {} SINIFI ANALİZİ"
CLASS_DEFINED = "- {} sınıfı tanımlanmış"
CLASS_METHODS = "- Metodları: {}"
SUMMARY_STEP = "ADIM {}: ÇAĞRI İLİŞKİLERİ ÖZETİ"
SUMMARY_FUNCTION = "FONKSIYON: {}"
SUMMARY_CALLS = "ÇAĞIRIYOR: {}"
SUMMARY_NONE = "ÇAĞIRIYOR: YOK"


def _body(code: str, name: str) -> str | None:
    """The indented lines after the first definition of a function, or None if it has no plain head."""
    found = re.search(rf"def\s+{re.escape(name)}\s*\([^)]*\):[^\n]*\n((?:\s+[^\n]+\n)*)", code)
    return found[1] if found else None


def _methods(code: str, name: str) -> list[str]:
    found = re.search(rf"class\s+{re.escape(name)}[^:]*:((?:\n(?:\s+[^\n]+))*)", code)
    return re.findall(r"def\s+(\w+)\s*\(self", found[1]) if found else []


def mock_analysis(code: str) -> str:
    """Overview, a step for each function and class, and a block of calls for each function; callees are in order of their names."""
    functions, classes = re.findall(r"def\s+(\w+)\s*\(", code), re.findall(r"class\s+(\w+)", code)
    called = {f: re.findall(r"(\w+)\s*\(", body) if (body := _body(code, f)) is not None else None for f in functions}
    out = [OVERVIEW, OVERVIEW_COUNTS.format(len(functions), len(classes)), ""]
    step = 2
    for f in functions:
        others = None if called[f] is None else sorted({c for c in called[f] if c != f and c not in LEFT_OUT})
        line = FUNCTION_SEEN.format(f) if others is None else FUNCTION_CALLS.format(f, ", ".join(others)) if others else FUNCTION_NO_CALLS.format(f)
        out += [FUNCTION_STEP.format(step, f), line, ""]
        step += 1
    for c in classes:
        methods = _methods(code, c)
        out += [CLASS_STEP.format(step, c), CLASS_DEFINED.format(c), *([CLASS_METHODS.format(", ".join(methods))] if methods else []), ""]
        step += 1
    out.append(SUMMARY_STEP.format(step))
    for f in functions:
        out.append(SUMMARY_FUNCTION.format(f))
        if called[f] is not None:
            known = [c for c in called[f] if c in functions and c != f]
            out.append(SUMMARY_CALLS.format(", ".join(known)) if known else SUMMARY_NONE)
        out.append("")
    return "\n".join(out)


def mock_steps(content: str) -> list[str]:
    """The narrative's steps: a line that begins with ADIM or FONKSIYON: begins one."""
    steps: list[list[str]] = []
    for line in content.split("\n"):
        if line.startswith(("ADIM", "FONKSIYON:")):
            steps.append([line])
        elif steps:
            steps[-1].append(line)
    return ["\n".join(s) for s in steps]
