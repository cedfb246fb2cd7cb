"""Full texts of known licences, with their usual titles, numberings and wordings.

The short licences are built from the texts in ``license_digests``; the long ones lie as files in ``licenses/``,
``NAME.txt`` and further editions as ``NAME.b.txt``. Read on the driver only.
"""

from __future__ import annotations

import itertools
import re
from importlib import resources

_ADDRESS = r"51 Franklin St(?:reet)?, Fifth Floor,\s+Boston,? MA\s+02110-1301,?\s+USA"
_ADDRESSES = (
    "51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "51 Franklin St, Fifth Floor, Boston, MA 02110-1301 USA",
    "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "59 Temple Place - Suite 330, Boston, MA 02111-1307, USA",
    "675 Mass Ave, Cambridge, MA 02139, USA",
)


def _titles(*names: str) -> list[str]:
    return ["", *(f"{the}{name}\n\n" for name in names for the in ("", "The "))]


_MIT = _titles("MIT License", "MIT License (MIT)", "MIT Licence", "Expat License", "X11 License", "MIT") + ["License\n\n", "License: MIT\n\n"]
_ISC = _titles("ISC License", "ISC License (ISC)", "ISC License (ISCL)", "ISC")
_0BSD = _titles("BSD Zero Clause License", "Zero-Clause BSD", "Zero Clause BSD License", "0BSD License", "0BSD", "BSD-0-Clause License")
_BSD = ("BSD License", "BSD Licence", "BSD")
_BSD2 = _titles(*_BSD, "BSD 2-Clause License", "2-Clause BSD License", "BSD 2-Clause", "BSD-2 License", "Simplified BSD License", "FreeBSD License",
                "BSD 2-Clause \"Simplified\" License")
_BSD3 = _titles(*_BSD, "BSD 3-Clause License", "3-Clause BSD License", "BSD 3-Clause", "BSD-3 License", "New BSD License", "Modified BSD License",
                "Revised BSD License", "BSD 3-Clause \"New\" or \"Revised\" License")
_NUMBERS = (("1.", "2.", "3."), ("*", "*", "*"), ("a.", "b.", "c."))
_PARTIES = (  # who provides, who is not liable
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDER OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT OWNER OR CONTRIBUTORS"),
    ("COPYRIGHT HOLDERS AND CONTRIBUTORS", "COPYRIGHT HOLDERS OR CONTRIBUTORS"), ("COPYRIGHT HOLDERS", "COPYRIGHT HOLDERS"), ("AUTHOR", "AUTHOR"),
    ("AUTHORS", "AUTHORS"), ("AUTHOR AND CONTRIBUTORS", "AUTHOR OR CONTRIBUTORS"), ("REGENTS AND CONTRIBUTORS", "REGENTS OR CONTRIBUTORS"),
)
_MAY = "may be used to endorse or promote products derived from this software without specific prior written permission. "
_MAY_NOT = _MAY.replace("may be", "may not be")
_ENDORSE = (
    *(f"Neither the name of the {who} nor the names of its contributors {_MAY}"
      for who in ("copyright holder", "copyright owner", "author", "University", "organization", "project", "company")),
    f"Neither the names of the copyright holders nor the names of their contributors {_MAY}",
    f"Neither the name of the copyright holders nor the names of its contributors {_MAY}",
    f"Neither the name of the copyright holder nor the names of contributors {_MAY}",
    f"The name of the author {_MAY_NOT}", f"The names of its contributors {_MAY_NOT}", f"The names of the authors {_MAY_NOT}",
)


def _short(known: dict[str, str]):
    body = known["MIT"].removeprefix("MIT License\n\n")
    for title, quotes, more, non in itertools.product(_MIT, '"“', ("", " (including the next paragraph)"), ("NON", "NON-")):
        text = body if quotes == '"' else re.sub('"([^"]*)"', "“\\1”", body)
        yield "MIT", title + text.replace("this permission notice", "this permission notice" + more).replace("NONINFR", non + "INFR")
    for name, titles in (("ISC", _ISC), ("0BSD", _0BSD)):
        body = known[name].removeprefix("ISC License\n\n")
        for title, how, (who, verb) in itertools.product(titles, ("and/or", "and"), (
                ("THE AUTHOR", "DISCLAIMS"), ("THE AUTHORS", "DISCLAIM"), ("ISC", "DISCLAIMS"), ("THE COPYRIGHT HOLDER", "DISCLAIMS"))):
            text = body.replace("and/or", how).replace("THE AUTHOR DISCLAIMS", f"{who} {verb}").replace("THE AUTHOR BE", f"{who} BE")
            yield name, title + text
    body = known["BSD-2-Clause"]
    split = body.index("THIS SOFTWARE IS PROVIDED")
    for numbers, (gives, owes) in itertools.product(_NUMBERS, _PARTIES):
        head = body[:split].replace("1. ", numbers[0] + " ").replace("2. ", numbers[1] + " ")
        tail = body[split:].replace("COPYRIGHT HOLDERS AND CONTRIBUTORS", gives).replace("COPYRIGHT HOLDER OR CONTRIBUTORS", owes)
        for title in _BSD2:
            yield "BSD-2-Clause", title + head + tail
        for title, endorse in itertools.product(_BSD3, _ENDORSE):
            yield "BSD-3-Clause", f"{title}{head}{numbers[2]} {endorse}{tail}"


def _parts(text: str):
    """The text, and without what is often left out around its terms."""
    yield text
    for end in (r"(?m)^[ \t]*END OF TERMS AND CONDITIONS[ \t]*$", r"(?m)^Exhibit A - "):
        if found := re.search(end, text):
            yield text[: found.end()] if "END" in end else text[: found.start()]
            yield text[: found.start()]
    if "ADDENDUM: How to use" in text:
        yield text[: text.index("ADDENDUM: How to use")]
    begin, ends = re.search(r"(?m)^Creative Commons [^\n]*4\.0 International Public$", text), [m.start() for m in re.finditer("(?m)^====", text)]
    if begin and ends:
        yield text[begin.start(): ends[-1]]


def _long():
    for file in sorted(resources.files(__package__).joinpath("licenses").iterdir(), key=lambda f: f.name):
        if not file.name.endswith(".txt"):
            continue
        name, text = re.sub(r"(\.b)?\.txt$", "", file.name), file.read_text(encoding="utf-8")
        for part in _parts(text):
            yield name, part
            first = re.search(_ADDRESS, part)
            if first:
                rest = part[first.end():]
                for own, other in itertools.product(("", *_ADDRESSES), _ADDRESSES):
                    yield name, part[: first.start()] + own + re.sub(_ADDRESS, other, rest)


def full_texts(known: dict[str, str]) -> list[tuple[str, str]]:
    """(licence, text) of every title, numbering and wording; ``known`` holds the short texts."""
    return [*_short(known), *_long()]
