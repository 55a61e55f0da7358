"""Complete licence texts and standard headers, in the forms in which they are published."""

from __future__ import annotations

import re
from importlib.resources import files

#: Whole texts in licenses/, and what starts the part that many copies leave out.
COMPLETE = {"Apache-2.0": "APPENDIX: How to apply", "GPL-2.0": "How to Apply These Terms", "GPL-3.0": "How to Apply These Terms", "LGPL-2.1": "How to Apply These Terms", "LGPL-3.0": None, "MPL-2.0": "Exhibit A - Source Code Form", "CC0-1.0": None, "Unlicense": "For more information, please refer"}
#: First and last words of the header that files under a licence carry; it stands in the text itself.
HEADERS = {
    "Apache-2.0": ('Licensed under the Apache License, Version 2.0 (the "License");', "limitations under the License."),
    "GPL-2.0": ("This program is free software;", "MA 02110-1301 USA."),
    "GPL-3.0": ("This program is free software:", "<https://www.gnu.org/licenses/>."),
    "LGPL-2.1": ("This library is free software;", "MA  02110-1301  USA"),
    "MPL-2.0": ("This Source Code Form is subject to the terms", "at http://mozilla.org/MPL/2.0/."),
}
TITLES = {"MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("", "ISC License"), "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD"), "BSD-2-Clause": ("", "BSD 2-Clause License", "The 2-Clause BSD License"), "BSD-3-Clause": ("", "BSD 3-Clause License", "The 3-Clause BSD License")}


def _text(name: str) -> str:
    """A text with each paragraph on one line, so that no line happens to start like a copyright line."""
    text = (files(__package__) / "licenses" / f"{name}.txt").read_text(encoding="utf-8")
    return "\n\n".join(" ".join(p.split()) for p in re.split(r"\n\s*\n", text))


def _raw(name: str) -> str:
    return (files(__package__) / "licenses" / f"{name}.txt").read_text(encoding="utf-8")


def _bsd() -> list[tuple[str, str]]:
    """(id, text): clauses with and without numbers, and the words that differ between copies."""
    body, out = _text("BSD-3-Clause"), []
    for holder in ("HOLDER", "OWNER", "HOLDERS"):
        one = body.replace("COPYRIGHT HOLDER OR", f"COPYRIGHT {holder} OR")
        two = re.sub(r"3\. Neither.*?\n\n", "", one)
        three = [one.replace("the name of the copyright holder nor", f"the name of {name} nor") for name in ("the copyright holder", "the copyright owner", "the author", "the University")]
        for license_id, text in [("BSD-2-Clause", two), *[("BSD-3-Clause", t) for t in three]]:
            out += [(license_id, text), (license_id, re.sub(r"(?m)^\d\. ", "", text))]
    return out


def complete_texts() -> list[tuple[str, str]]:
    """(license id, text) of whole licences, with and without appendix, title and the line on rights."""
    out = []
    for name, rest in COMPLETE.items():
        raw = _raw(name)
        texts = [raw, raw[: raw.index(rest)]] if rest else [raw]
        out += [(name, t) for t in texts]
    permission = _text("0BSD")
    isc = permission.replace("is hereby granted.", "is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", 1)
    for name, text in [("MIT", _text("MIT")), ("ISC", isc), ("0BSD", permission), *_bsd()]:
        for title in TITLES[name]:
            out += [(name, f"{title}\n\n{text}"), (name, f"{title}\n\nAll rights reserved.\n\n{text}")]
    return out


def headers() -> list[tuple[str, str]]:
    """(license id, text) of each standard header, whole and as its first paragraph, and of the clause that only BSD-3-Clause has."""
    out = []
    for name, (first, last) in HEADERS.items():
        raw = _raw(name)
        lo = raw.rindex(first)
        text = raw[lo : raw.index(last, lo) + len(last)]
        out += [(name, text), (name, re.split(r"\n\s*\n", text)[0])]
    for name in ("the copyright holder", "the copyright owner", "the author", "the University"):
        clause = f"Neither the name of {name} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
        out += [("BSD-3-Clause", clause), ("BSD-3-Clause", f"3. {clause}")]
    return out
