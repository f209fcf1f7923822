"""Extraction rules in Markdown: templates with {logical_name} that become regular expressions."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def compile_template(template: str) -> str:
    """A regular expression in which {name} is a lazy named group, white space is loose and everything else is literal."""
    out = ""
    for part in re.split(r"(\{\w+\})", template.replace("\\n", "\n")):
        if re.fullmatch(r"\{\w+\}", part):
            name = part[1:-1]
            out += f"(?P<{'logical_name' if name == 'local_name' else name}>[^\\n]+?)"
        else:
            out += r"\s*".join(re.escape(x) for x in re.split(r"\s+", part))
    return out


def templates(text: str) -> dict[str, str]:
    """Section title -> template: the first quoted text of each second-level section that holds a placeholder."""
    found = {}
    for section in re.split(r"(?m)^##\s+", text)[1:]:
        title = section.split("\n", 1)[0].strip()
        quoted = re.findall(r"`([^`\n]*\{\w+\}[^`\n]*)`|'([^'\n]*\{\w+\}[^'\n]*)'", section)
        if quoted:
            found[title] = next(x for x in quoted[0] if x)
    return found


def load(spark: SparkSession, folder: str, project: str | None = None) -> dict[str, str]:
    """Section title -> regular expression of the default rule files, and over them of <project>_logical_name_rules.md. The files are few and small."""
    from .files import whole_files

    rows = whole_files(spark, folder, "*rule*.md").collect()
    own = f"{project}_logical_name_rules.md" if project else None
    picked = [r for r in rows if not r.file_path.endswith("_logical_name_rules.md")] + [r for r in rows if own and r.file_path.endswith("/" + own)]
    out: dict[str, str] = {}
    for r in picked:
        out |= {title: compile_template(t) for title, t in templates(r.value).items()}
    return out
