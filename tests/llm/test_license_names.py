import re

import pytest

from syndrift.llm import licenses

SPDX = {
    "MIT": "mit", "MIT-0": "mit-0", "X11": "x11", "ISC": "isc", "BSD-2-Clause": "bsd-2-clause", "BSD-3-Clause": "bsd-3-clause", "BSD-4-Clause": "bsd-4-clause", "0BSD": "0bsd",
    "Apache-1.1": "apache-1.1", "Apache-2.0": "apache-2.0", "AGPL-1.0-only": "agpl-1.0", "AGPL-3.0": "agpl-3.0", "AGPL-3.0-or-later": "agpl-3.0", "LGPL-2.0-only": "lgpl-2.0", "LGPL-2.1": "lgpl-2.1",
    "LGPL-2.1-or-later": "lgpl-2.1", "LGPL-3.0-only": "lgpl-3.0", "GPL-1.0": "gpl-1.0", "GPL-2.0+": "gpl-2.0", "GPL-2.0-only": "gpl-2.0", "GPL-3.0-only": "gpl-3.0", "GPL-3.0-or-later": "gpl-3.0",
    "GFDL-1.3-or-later": "gfdl", "MPL": "mpl", "MPL-1.0": "mpl-1.0", "MPL-1.1": "mpl-1.1", "MPL-2.0": "mpl-2.0", "EPL-1.0": "epl-1.0", "EPL-2.0": "epl-2.0", "EUPL-1.2": "eupl", "CDDL-1.0": "cddl",
    "CPL-1.0": "cpl", "Artistic-2.0": "artistic-2.0", "BSL-1.0": "bsl-1.0", "BUSL-1.1": "busl", "Zlib": "zlib", "PostgreSQL": "postgresql", "Python-2.0": "python", "PSF-2.0": "python", "PHP-3.01": "php",
    "Ruby": "ruby", "OpenSSL": "openssl", "OFL-1.1": "ofl", "WTFPL": "wtfpl", "Unlicense": "unlicense", "ODbL-1.0": "odbl", "ODC-By-1.0": "odc-by", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "CC0-1.0": "cc0",
    "CC-BY-4.0": "cc-by", "CC-BY-SA-4.0": "cc-by-sa", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-NC-SA-4.0": "cc-by-nc-sa", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-NC-ND-4.0": "cc-by-nc-nd",
}
TEXTS = [(f"SPDX-License-Identifier: {k}", v) for k, v in SPDX.items()] + [
    ("licensed under GPLv2", "gpl-2.0"), ("released under the LGPL", "lgpl"), ("under the terms of the GPL v3", "gpl-3.0"), ("available under LGPL 2.1 license", "lgpl-2.1"), ("AGPLv3 licensed", "agpl-3.0"),
    ("all_rights_reserved", "proprietary"), ("released_under_mit", "mit"), ("placed in the public_domain", "public-domain"), ("subject_to_the_terms_of_the_mit", "mit"),
]


def test_every_id_and_abbreviation(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(TEXTS)], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in licenses.report(licenses.scan(df)).collect()}
    assert got == {i: want for i, (_, want) in enumerate(TEXTS)}


@pytest.mark.parametrize("mark", [" ", "_", "-", "\n * "])
def test_gate_loses_no_match(mark):
    phrases = ["spdx license identifier mit", "licensed to you under the terms of the mit", "provided under mit", "distributed to you under mit", "dual licensed as mit", "under the conditions of mit", "subject to the terms and conditions of the mit", "licence is the mit", "mit licensed",
               "permission is hereby granted", "redistribution and use", "any express or implied warranty", "work is in the public domain", "all rights reserved", "proprietary and confidential", "without written permission"]
    assert all(re.search(licenses.GATE, p.replace(" ", mark), re.ASCII) for p in phrases)
