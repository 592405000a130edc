"""License scans by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (cases, punctuation, copyright lines and
equivalent spellings don't count) and its digest is joined to those of known
licenses. Single lines that name a license are looked up in the same way.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ODD, _PLAIN = "‘’“”–— ©", "''\"\"-- @"  # typographic characters; @ stands for the copyright sign
#: Lines that state a copyright: not the sentences that merely begin a line with that word.
_COPYRIGHT = r"(?m)^[^a-z0-9\n(@]*(?:copyright[ \t]+(?:\(c\)|@|[0-9<\[{])|\(c\)[ \t]*(?:copyright|[0-9])|@[ \t]*(?:copyright|[0-9]))[^\n]*"
_RESERVED = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"
_PUNCTUATION = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Every notice holds one of these stems before punctuation goes, at whatever length; other lines need no digest.
_STEMS = r"(?s)licen|gpl|cc0|cc[\x00-\x2F\x3A-\x60\x7B-\x7F].*by"
#: Spellings that count as equal, in the form of the second.
SPELLINGS = (
    ("licence", "license"),
    ("licences", "licenses"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("acknowledgements", "acknowledgments"),
    ("authorise", "authorize"),
    ("authorised", "authorized"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("favour", "favor"),
    ("honour", "honor"),
    ("fulfil", "fulfill"),
    ("noncommercial", "non  commercial"),
    ("https", "http"),
)

_WARRANTY_MIT = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_PERMISSION_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"""
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_APACHE_NOTICE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""

#: Texts of public licenses and of their standard notices.
TEXTS = {
    "MIT": f"{_PERMISSION_MIT}\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n{_WARRANTY_MIT}",
    "MIT-0": f"{_PERMISSION_MIT.removesuffix(', subject to the following conditions:')}.\n{_WARRANTY_MIT}",
    "ISC": f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.\n{_ISC_END}",
    "0BSD": f"{_ISC}.\n{_ISC_END}",
    "BSD-2-Clause": f"{_BSD}{_BSD_END}",
    "BSD-3-Clause": f"{_BSD}{_BSD_THIRD}{_BSD_END}",
    "Zlib": _ZLIB,
    "Apache-2.0": _APACHE_NOTICE,
}
#: A license's text may stand below its title.
TITLES = {"MIT": ("MIT License", "The MIT License", "The MIT License (MIT)"), "ISC": ("ISC License",), "0BSD": ("BSD Zero Clause License",), "BSD-2-Clause": ("BSD 2-Clause License",), "BSD-3-Clause": ("BSD 3-Clause License",), "Zlib": ("zlib License",), "MIT-0": ("MIT No Attribution",), "Apache-2.0": ()}

#: Digests of the complete published texts that are too long to hold here. With terms and conditions that end in so
#: many words, also those of the terms alone; with an address of the Free Software Foundation, also those with its other addresses.
WHOLE = {
    "Apache-2.0": (
        "37599287c15c2f2ec060c3c3b55bdf69e3bc7a8aeeb9cd57e18800088789538a",
        "e87dea5078ce2faaea46d3475af18d30a5c0ac0f09425b60b3e0c6569f72f8d2",
        "f45538b138cf9aea39fa205de037a0bede8305e68281650e7ab809a8b3ebb2f0",
    ),
    "CC0-1.0": (
        "96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f",
    ),
    "GFDL-1.2": (
        "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
        "4586dba5ddfcf100fb8904f8e9ed3b5c8475c6a35c144d40b2c7904ea874cef1",
        "5c083164ec08b233a6e2819c8c6d4f66a18fb74372858b0f8f418511dfd7adc0",
        "a1f0df2b18313280767d46545d9055f62d3e43865e62729dcfd6ec0c0c240ca2",
        "e6f66d6529be963cd45c5fbf5070316f057cfffe5c500c29cdeb73e2705efa5c",
    ),
    "GFDL-1.3": (
        "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
    ),
    "GPL-1.0": (
        "103444fe1c8dfca55cdf2e4a0bd5537c9b3b02f67b083009b51a6147f3ea0771",
        "279987e5b4fbc129575445f4b90d696cf8aece2c0747ab53fac60e2b3085294a",
        "2922a6c5465bb5e85c815530eac3fb465c2e2b47792476b05b5a445995a06db8",
        "2f63911c9c4734b0223210fa113db3e7df3f58bd206e0bc7753dc10d5d5684c4",
        "444b4c04dac73b733048485ddb8170579446a51fc8e3ee08782b92502dd3d12b",
        "551f7eeed97f9ed5deb368e9c30caca5034d5f84aa999d5e8221f197ef53c02d",
        "5842b52ceb844de1201fed26a46a7d76beb66cd0c286c65d4437ae2fa114e63f",
        "5ded46d775fc985df877cf7813481ef515fda58aa6fc3c944ec08fea69e6f5ac",
        "6ae1b69a12d592119232442f6cf32b3c6c1b6b6e10f84628fa79a408a8010766",
        "74d0cd23803c9754c36f6ca0e1af411b418ed6b6564e757472bf0d870a1b5d1b",
        "8f55f35f77922f430bbc8db35d1da67cded88663a158501bbb9728b56df01a63",
        "af30c0af27b90ec812acdb040f3dcc944a87cd893456690efe35063f39e3eeeb",
        "c0d2e7beb817cd9654cd182972b17fa9c473e30e8f85502b8b0527e5257d2e4c",
        "d7098210c9a5ec526933e54b38d608a6b53d39fa1e2b00837a7875c9d0dc0b69",
        "ec8a6b7d70e9f225b63d3962ed5b4721373f5535d7b967a06722b0d621f6892a",
    ),
    "GPL-2.0": (
        "1551b61aa183f987ecceedd8966ec1e9b2da3848f8862c2adedc0d82f41904ca",
        "17191e3ea4f31effe9815ccc8f65b5ac550606320e016ae896b8339a95eded7c",
        "22578535822c4d3e84810681a2b06ab0d73949f47259b59534d208e07d00767e",
        "2cafd97fd00bbc71467851cbb0a12e0e0668b9baa165834ff9c4974b36490ac6",
        "331b500eb3c5ee796906547305df82fff4a35b3aa03c1d3ea84d32078292b2e6",
        "448cf8c5c0971f72c82bb38d9ddaa10b773a02e96799f6ee8ade3a5c7ddb3161",
        "8582b50782c3f365963006c96fb4cc24b483318da6bad1aba7caaf172ce02786",
        "8d657eea7cb55320b5a1f94aae724b61dd96d5bbef37505b32f0c80ec1f15cca",
        "c67cc53030ae25fe2e2f0143b59060eca5ad89da8d2beca1445641234d29fc88",
        "d3202b69e0dd53f7056f827119db298e0fff195fefd77fcc0a3ee5676b7005eb",
        "e9c8c1142c2fc51f334d02ff7515749793fe67252cecfd480a300475eef05677",
        "efa536c0edc46f48d6458ef2529ddec8f411b419d48ebe2624ac0ed82fac808f",
    ),
    "GPL-3.0": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.0": (
        "084782a05c82d5e85c704f06bab601971e84b3b9b90a51c95ffcff2b342d9cf2",
        "131388cef61b641f00bceb32a526ff287eda43908ab6408d1410f4b71d790bdb",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "5ce88337a2fce97b0f2b6aac63afc49927c0dc31e15bf530a83e603e1d298d8b",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
        "a81dc978fadd02c3eff207527eb4a22553274171195763efbd5741494d35895c",
        "cbc927caf696ef44b2fbebe29ffa45a5fccf0a64c78f2b85678a11032ebb3318",
        "d40504a2bf1a1a86ee76e642ced31126577d21774b1ac0a222ce730ec78d7108",
        "dc842683831d008ff5f32600206cfd765e4d05df71fe831b1b4b31462fa2fff1",
        "fcc600ccfe1dcd7f97b591f551eda2d2e82c1adfdb8fdc97ff83113522de9949",
        "feb45efa998ac9d6ca85b1b2b7dfb124a14b1e88f579d2de38fe3a7970ce7380",
    ),
    "LGPL-2.1": (
        "0de2e3ba00ed5f309ce9d71663e50ea414063f6e46865f2d80d4ad038f268c87",
        "3bde1ca18489d8594a2c0c04b5ae1003c1795d1680675f4ef758325e1e1c3169",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "925c28788af11361f32b5b10dbeb4454be64e8448ed4a7c0926618a5d8a85bfb",
        "a5ac783c64dc7fa3fe7b641692ee7b8da491bd87f613c9bb99618a9469e71c47",
        "ba3552e93941e64a507d59501d0801033f6066b03705f06c855659ef59655bbf",
        "bd06b7347431b0fc243c0e32d1668ab362329b4a591386570abd310334f6fbdb",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "d749c17ba9dff042b3ecbe652dfabdd5f542c229304d1af0f9cb193ee9b99d55",
        "df8b7d554d9ba4683d95046dc0cd8fdf6c063841a3cfabcf242ab40e69237421",
        "ee28f6b96eee79efb651db0d57cb3afa685735c85662fb700e4a4b4e4725f8a2",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a",
    ),
}

#: Names of licenses in notices, and the sentences that such names stand in.
NAMES = {
    "MIT": ("MIT License", "MIT license"),
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU GPL version 2", "GPL v2"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU GPL version 3", "GPL v3"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("GNU Affero General Public License, version 3",),
    "BSD-2-Clause": ("BSD 2-Clause License",),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD License"),
    "MPL-2.0": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0"),
    "ISC": ("ISC License",),
    "CC0-1.0": ("CC0 1.0",),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
}
SENTENCES = ("{}", "Released under {}", "Released under the {}", "Licensed under {}", "Licensed under the {}", "This work is licensed under {}", "This work is licensed under the {}", "This work is licensed under a {}", "Distributed under the {}", "License: {}")


def canonical_text(text: str) -> str:
    """What canonical() makes of a text, for the known ones."""
    t = text.translate(str.maketrans(_UPPER + _ODD, _LOWER + _PLAIN))
    t = re.sub(_RESERVED, "", re.sub(_COPYRIGHT, "", t))
    t = " " + re.sub(_PUNCTUATION, "  ", t) + " "
    for a, b in SPELLINGS:
        t = t.replace(f" {a} ", f" {b} ")
    return " ".join(x for x in t.split(" ") if x)


def canonical(text: Column) -> Column:
    """Words in lower case with single spaces between; copyright lines are gone, spellings are one. Letters beyond ASCII stay."""
    t = F.translate(text, _UPPER + _ODD, _LOWER + _PLAIN)
    t = F.regexp_replace(F.regexp_replace(t, _COPYRIGHT, ""), _RESERVED, "")
    t = F.concat(F.lit(" "), F.regexp_replace(t, _PUNCTUATION, "  "), F.lit(" "))
    for a, b in SPELLINGS:
        t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(F.regexp_replace(t, " +", " "))


def _digest(text: str) -> str:
    return hashlib.sha256(canonical_text(text).encode()).hexdigest()


def known_texts() -> dict[str, str]:
    """digest -> license, of whole texts, with and without a title."""
    out = {}
    for name, text in TEXTS.items():
        for title in ("", *TITLES[name]):
            out[_digest(f"{title}\n{text}")] = name
    return out | known_notices()


def known_notices() -> dict[str, str]:
    """digest -> license, of single lines; made by the rule that each name stands in each sentence."""
    return {_digest(s.format(n)): name for name, names in NAMES.items() for n in names for s in SENTENCES}


def variants() -> dict[str, str]:
    """digest -> license, of usual variants of the texts held here, with and without a title."""
    thirds = [_BSD_THIRD.replace("the copyright holder", x) for x in ("the copyright holder", "the copyright holders", "the copyright owner", "<organization>", "the <organization>", "the University", "the author")]
    ends = [_BSD_END.replace("COPYRIGHT HOLDER OR", x) for x in ("COPYRIGHT HOLDER OR", "COPYRIGHT HOLDERS OR", "COPYRIGHT OWNER OR")]
    ends += [_BSD_END.replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("COPYRIGHT HOLDER OR", "REGENTS OR"), _BSD_END.replace("SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS", "SHALL <COPYRIGHT HOLDER>")]
    bullets = lambda t: re.sub(r"(?m)^[0-9]\. ", "* ", t)
    forms = {
        "MIT": [TEXTS["MIT"].replace("this permission notice shall", "this permission notice (including the next paragraph) shall")],
        "ISC": [TEXTS["ISC"].replace(_ISC, w).replace("THE AUTHOR", a) for w in (_ISC, _ISC.replace("and/or", "and")) for a in ("THE AUTHOR", "THE AUTHORS", "ISC", "THE COPYRIGHT HOLDER")],
        "BSD-2-Clause": [f(_BSD + e) for e in ends for f in (str, bullets)],
        "BSD-3-Clause": [f(_BSD + t + e) for t in thirds for e in ends for f in (str, bullets)],
    }
    return {_digest(f"{title}\n{t}"): name for name, texts in forms.items() for t in texts for title in ("", *TITLES[name])}


def whole_texts() -> dict[str, str]:
    """digest -> license, of all whole texts that are looked up."""
    return {d: name for name, digests in WHOLE.items() for d in digests} | variants() | known_texts()


def scanned(documents: DataFrame) -> DataFrame:
    """(doc_id, digest, license, n_notices, notices), a row for each row of documents.

    digest is that of the canonical whole text (a null text counts as empty); license is null if it isn't known.
    notices are the licenses that single lines name, distinct, sorted, joined by commas; n_notices counts such lines.
    Repeated rows are scanned alike, an empty table stays empty, other columns are not read."""
    spark = documents.sparkSession
    known = spark.createDataFrame(sorted(whole_texts().items()), "digest string, license string")  # a fixed table of a few hundred rows
    text = F.coalesce("text", F.lit(""))
    names = F.create_map(*(F.lit(x) for pair in sorted(known_notices().items()) for x in pair))
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, _UPPER + _ODD, _LOWER + _PLAIN).rlike(_STEMS))
    found = F.filter(F.transform(lines, lambda x: F.try_element_at(names, F.sha2(canonical(x).cast("binary"), 256))), lambda x: x.isNotNull())
    whole = documents.select("doc_id", F.sha2(canonical(text).cast("binary"), 256).alias("digest"), found.alias("found"))
    return whole.join(F.broadcast(known), "digest", "left").select(
        "doc_id", "digest", "license", F.size("found").cast("long").alias("n_notices"), F.array_join(F.array_sort(F.array_distinct("found")), ",").alias("notices")
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    q = lambda s: s.replace("'", "''")

    def canon(t: str) -> str:
        t = f"translate({t}, '{q(_UPPER + _ODD)}', '{q(_LOWER + _PLAIN)}')"
        t = f"regexp_replace(regexp_replace({t}, '{_COPYRIGHT}', '', 'g'), '{_RESERVED}', '', 'g')"
        t = f"' ' || regexp_replace({t}, '{_PUNCTUATION}', '  ', 'g') || ' '"
        for a, b in SPELLINGS:
            t = f"replace({t}, ' {a} ', ' {b} ')"
        return f"trim(regexp_replace({t}, ' +', ' ', 'g'), ' ')"

    values = lambda d: ", ".join(f"('{k}', '{v}')" for k, v in sorted(d.items()))
    return f"""
WITH known(digest, license) AS (VALUES {values(whole_texts())}),
notice(digest, name) AS (VALUES {values(known_notices())}),
d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
line AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
hit AS (SELECT doc_id, name FROM line JOIN notice ON notice.digest = sha256({canon("l")})),
per AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM hit GROUP BY doc_id),
whole AS (SELECT doc_id, sha256({canon("t")}) AS digest FROM d)
SELECT w.doc_id, w.digest, known.license, CAST(coalesce(per.n, 0) AS BIGINT) AS n_notices, coalesce(per.names, '') AS notices
FROM whole w LEFT JOIN known USING (digest) LEFT JOIN per USING (doc_id)"""


QUERIES = {"op1_licenses": op1_licenses}
ORACLES = {"op1_licenses": _oracle()}
