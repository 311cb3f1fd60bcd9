"""Known licence sentences and ordered rules. In a wording, {} stands for up to ten words of any kind (a name, a year, a list)."""

from __future__ import annotations

_V = "of the License, or (at your option) any later version."
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"


def _short(*names: str) -> list[str]:
    heads = ("Licensed under the", "Released under the", "Distributed under the", "Available under the", "This work is licensed under the", "This work is licensed under a", "This project is licensed under the", "This software is licensed under the", "This program is licensed under the", "Licensed under", "This work is licensed under")
    return [f"{h} {n}" for n in names for h in heads]


def _gnu(what: str, name: str, version: str) -> list[str]:
    subject = {"program": "This program is free software", "library": "This library is free software"}[what]
    act = ["you can redistribute it and/or modify it under the terms of", "you can redistribute it and/or modify it under"]
    either = [f"either version {version} {_V}"] + ([f"either version {version[0]} {_V}"] if version.endswith(".0") else [])
    return [f"{subject}{mark} {a} the GNU {name} as published by the Free Software Foundation{sep} {e}" for mark in (":", ";") for a in act for sep in (",", ";") for e in either]


#: Identifier -> wordings.
SENTENCES: dict[str, list[str]] = {
    # permissive
    "apache2_short": _short("Apache License, Version 2.0.", "Apache License, Version 2.0 (the \"License\");", "Apache License 2.0", "Apache-2.0 License", "Apache 2.0 License", "Apache Software License, Version 2.0") + ["Apache License Version 2.0, January 2004"],
    "file_comply": ["you may not use this file except in compliance with the License."],
    "apache2_obtain": ["You may obtain a copy of the License at"],
    "apache2_asis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "apache1_name": ["The end-user documentation included with the redistribution, if any, must include the following acknowledgment:", "All advertising materials mentioning features or use of this software must display the following acknowledgment:"],
    "apache1_foundation": ["This product includes software developed by the Apache Software Foundation {}", "This product includes software developed by the Apache Software Foundation", "This product includes software developed by the Apache Group for use in the Apache HTTP server project {}"],
    "mit_short": _short("MIT License.", "MIT license", "MIT.", "terms of the MIT license") + ["The MIT License (MIT)", "MIT License", "The MIT License", "License: MIT", "SPDX-License-Identifier: MIT"],
    "mit_grant": [_GRANT],
    "mit_notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit_notice_next": ["The above copyright notice and this permission notice (including the next paragraph) shall be included in all copies or substantial portions of the Software."],
    "mit_asis": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "mit0_grant": [_GRANT.replace(", subject to the following conditions:", ".")],
    "x11_advertise": ["Except as contained in this notice, the name of {} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {}"],
    "isc_short": _short("ISC License.", "ISC license") + ["ISC License", "The ISC License"],
    "isc_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "bsd0_grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "isc_asis": ["THE SOFTWARE IS PROVIDED \"AS IS\" AND {} DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."],
    "bsd_grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd_source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd_binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd_advertise": ["All advertising materials mentioning features or use of this software must display the following acknowledgement:"],
    "bsd_endorse": ["Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Neither the name of {} nor the names of {} may be used to endorse or promote products derived from this software without specific prior written permission."],
    "bsd_short": _short("BSD License.", "BSD 3-Clause License", "3-Clause BSD License", "BSD-3-Clause License", "New BSD License", "Modified BSD License") + ["BSD 3-Clause License", "SPDX-License-Identifier: BSD-3-Clause"],
    "bsd2_short": _short("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License") + ["BSD 2-Clause License", "SPDX-License-Identifier: BSD-2-Clause"],
    "zlib_asis": ["This software is provided 'as-is', without any express or implied warranty."],
    "zlib_grant": ["Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"],
    "zlib_origin": ["The origin of this software must not be misrepresented; you must not claim that you wrote the original software."],
    "zlib_altered": ["Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software."],
    "zlib_short": _short("zlib License.", "zlib/libpng License"),
    "boost_short": _short("Boost Software License, Version 1.0.", "Boost Software License 1.0") + ["Boost Software License - Version 1.0 - August 17th, 2003", "Distributed under the Boost Software License, Version 1.0 {}"],
    "boost_grant": ["Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:"],
    "unlicense_domain": ["This is free and unencumbered software released into the public domain."],
    "unlicense_anyone": ["Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "wtfpl_short": ["DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"],
    "wtfpl_copies": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed."],
    "artistic2_short": _short("Artistic License 2.0.", "Artistic License, Version 2.0") + ["The Artistic License 2.0", "Artistic License 2.0"],
    "artistic1_short": _short("Artistic License.") + ["The Artistic License"],
    "perl_terms": ["This program is free software; you can redistribute it and/or modify it under the same terms as Perl itself.", "This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.", "This is free software; you can redistribute it and/or modify it under the same terms as the Perl 5 programming language system itself."],
    "python_short": _short("Python Software Foundation License.", "PSF License") + ["PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2"],
    "postgres_grant": ["Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies."],
    "openssl_short": _short("OpenSSL license.") + ["This product includes software developed by the OpenSSL Project for use in the OpenSSL Toolkit {}"],
    "ncsa_grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "blueoak_short": _short("Blue Oak Model License 1.0.0.") + ["Blue Oak Model License"],
    "mulan_short": _short("Mulan PSL v2.") + ["{} is licensed under Mulan PSL v2."],
    # copyleft
    "gpl_short": _short("GNU General Public License.", "GNU GPL.", "GPL."),
    "gpl3_short": _short("GNU General Public License, version 3.", "GNU General Public License v3.0", "GNU General Public License v3", "GNU GPL v3", "GPLv3", "GPL-3.0") + ["GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"],
    "gpl2_short": _short("GNU General Public License, version 2.", "GNU General Public License v2.0", "GNU General Public License v2", "GNU GPL v2", "GPLv2", "GPL-2.0") + ["GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0"],
    "gpl3_redistribute": _gnu("program", "General Public License", "3"),
    "gpl2_redistribute": _gnu("program", "General Public License", "2"),
    "gpl2_only": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."],
    "gpl_warranty": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl_details": ["See the GNU General Public License for more details."],
    "gpl_received": ["You should have received a copy of the GNU General Public License along with this program.", "You should have received a copy of the GNU General Public License along with this program; if not, {}", "You should have received a copy of the GNU General Public License along with this program. If not, see {}"],
    "lgpl3_short": _short("GNU Lesser General Public License, version 3.", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0") + ["GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"],
    "lgpl21_short": _short("GNU Lesser General Public License, version 2.1.", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1") + ["GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"],
    "lgpl21_redistribute": _gnu("library", "Lesser General Public License", "2.1") + _gnu("program", "Lesser General Public License", "2.1"),
    "lgpl3_redistribute": _gnu("library", "Lesser General Public License", "3") + _gnu("program", "Lesser General Public License", "3"),
    "lgpl_warranty": ["This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "agpl3_short": _short("GNU Affero General Public License, version 3.", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0") + ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"],
    "agpl3_redistribute": _gnu("program", "Affero General Public License", "3"),
    "gfdl_grant": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {} or any later version published by the Free Software Foundation; with {}", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version {} or any later version published by the Free Software Foundation;"],
    "gfdl_short": _short("GNU Free Documentation License."),
    "mpl2_notice": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "mpl2_copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at {}", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "mpl2_short": _short("Mozilla Public License 2.0", "Mozilla Public License, version 2.0.", "MPL-2.0") + ["Mozilla Public License Version 2.0"],
    "mpl11_notice": ["The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License."],
    "epl2_notice": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at {}", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 {}"],
    "epl2_short": _short("Eclipse Public License 2.0", "Eclipse Public License v2.0", "EPL-2.0") + ["Eclipse Public License - v 2.0"],
    "epl1_notice": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 {}", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 {}"],
    "cddl_notice": ["The contents of this file are subject to the terms of the Common Development and Distribution License (the \"License\")."],
    "eupl_short": _short("EUPL.", "EUPL, Version 1.2 {}", "European Union Public Licence.") + ["Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\");"],
    "osl3_short": ["Licensed under the Open Software License version 3.0"],
    "cecill_notice": ["This software is governed by the CeCILL license under French law and abiding by the rules of distribution of free software."],
    "sspl_short": _short("Server Side Public License.", "Server Side Public License, version 1"),
    "busl_short": _short("Business Source License 1.1") + ["Business Source License 1.1"],
    "busl_grant": ["The Licensor hereby grants you the right to copy, modify, create derivative works, redistribute, and make non-production use of the Licensed Work."],
    "elastic_short": _short("Elastic License 2.0", "Elastic License") + ["Elastic License 2.0"],
    "polyform_nc_short": _short("PolyForm Noncommercial License 1.0.0.") + ["PolyForm Noncommercial License 1.0.0"],
    # contents and data
    "cc0_short": _short("CC0.", "CC0 1.0", "CC0 1.0 Universal", "Creative Commons CC0 1.0 Universal License") + ["CC0 1.0 Universal", "Creative Commons Legal Code CC0 1.0 Universal", "SPDX-License-Identifier: CC0-1.0"],
    "cc0_waive": ["To the extent possible under law, {} has waived all copyright and related or neighboring rights to this work.", "To the extent possible under law, {} have waived all copyright and related or neighboring rights to this work."],
    "ccbync_short": _short("CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License."),
    "ccbyncsa_short": _short("CC BY-NC-SA 4.0.", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    "ccbyncnd_short": _short("CC BY-NC-ND 4.0.", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    "ccbysa_short": _short("CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International License."),
    "ccbysa3_short": _short("CC BY-SA 3.0.", "Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "ccbynd_short": _short("CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "ccby_short": _short("CC BY 4.0.", "Creative Commons Attribution 4.0 International License."),
    "ccby3_short": _short("CC BY 3.0.", "Creative Commons Attribution 3.0 Unported License."),
    "odbl_short": _short("Open Database License.", "Open Data Commons Open Database License (ODbL).", "ODbL.") + ["This {} is made available under the Open Database License {}"],
    "odcby_short": _short("Open Data Commons Attribution License.", "ODC-By.") + ["This {} is made available under the Open Data Commons Attribution License {}"],
    "ogl_uk_short": ["Contains public sector information licensed under the Open Government Licence v3.0."] + _short("Open Government Licence v3.0."),
    "ofl_short": _short("SIL Open Font License, Version 1.1.") + ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "rights": ["All rights reserved."],
    "confidential": ["This {} is confidential and proprietary {}", "Unauthorized copying of this file, via any medium is strictly prohibited", "Unauthorized copying of this file, via any medium, is strictly prohibited."],
    "public_domain": ["This work is in the public domain.", "This work has been dedicated to the public domain.", "This file is in the public domain.", "Released into the public domain.", "Placed in the public domain."],
}
#: Ordered rules: (rule, licence, identifiers).
RULES: list[tuple[str, str, list[str]]] = [
    ("apache-2.0_notice", "Apache-2.0", ["apache2_short", "apache2_obtain", "apache2_asis"]),
    ("apache-2.0_body", "Apache-2.0", ["file_comply", "apache2_obtain", "apache2_asis"]),
    ("apache-2.0_short", "Apache-2.0", ["apache2_short"]),
    ("apache-1.1", "Apache-1.1", ["bsd_grant", "bsd_source", "bsd_binary", "apache1_name", "apache1_foundation"]),
    ("mit_whole", "MIT", ["mit_short", "mit_grant", "mit_notice", "mit_asis"]),
    ("mit_full", "MIT", ["mit_short", "mit_grant", "mit_notice"]),
    ("mit_grant", "MIT", ["mit_grant", "mit_notice"]),
    ("mit_next", "MIT", ["mit_grant", "mit_notice_next"]),
    ("mit_short", "MIT", ["mit_short"]),
    ("mit-0", "MIT-0", ["mit0_grant", "mit_asis"]),
    ("x11", "X11", ["mit_grant", "mit_notice", "mit_asis", "x11_advertise"]),
    ("isc", "ISC", ["isc_grant", "isc_asis"]),
    ("isc_grant", "ISC", ["isc_grant"]),
    ("isc_short", "ISC", ["isc_short"]),
    ("0bsd", "0BSD", ["bsd0_grant", "isc_asis"]),
    ("bsd-4-clause", "BSD-4-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_endorse"]),
    ("bsd-3-clause", "BSD-3-Clause", ["bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("bsd-3-clause_short", "BSD-3-Clause", ["bsd_short"]),
    ("bsd-2-clause", "BSD-2-Clause", ["bsd_grant", "bsd_source", "bsd_binary"]),
    ("bsd-2-clause_short", "BSD-2-Clause", ["bsd2_short"]),
    ("zlib", "Zlib", ["zlib_asis", "zlib_grant", "zlib_origin", "zlib_altered"]),
    ("zlib_grant", "Zlib", ["zlib_grant", "zlib_origin"]),
    ("zlib_short", "Zlib", ["zlib_short"]),
    ("bsl-1.0", "BSL-1.0", ["boost_grant"]),
    ("bsl-1.0_short", "BSL-1.0", ["boost_short"]),
    ("unlicense", "Unlicense", ["unlicense_domain", "unlicense_anyone"]),
    ("unlicense_short", "Unlicense", ["unlicense_domain"]),
    ("wtfpl", "WTFPL", ["wtfpl_short", "wtfpl_copies"]),
    ("wtfpl_short", "WTFPL", ["wtfpl_short"]),
    ("artistic-2.0_short", "Artistic-2.0", ["artistic2_short"]),
    ("artistic-1.0_short", "Artistic-1.0", ["artistic1_short"]),
    ("perl", "Artistic-1.0-Perl OR GPL-1.0-or-later", ["perl_terms"]),
    ("psf-2.0_short", "PSF-2.0", ["python_short"]),
    ("postgresql", "PostgreSQL", ["postgres_grant"]),
    ("openssl", "OpenSSL", ["openssl_short"]),
    ("ncsa", "NCSA", ["ncsa_grant"]),
    ("blueoak-1.0.0", "BlueOak-1.0.0", ["blueoak_short"]),
    ("mulanpsl-2.0", "MulanPSL-2.0", ["mulan_short"]),
    ("gpl-3.0_notice", "GPL-3.0", ["gpl3_redistribute", "gpl_warranty"]),
    ("gpl-3.0_notice_full", "GPL-3.0", ["gpl3_redistribute", "gpl_warranty", "gpl_details", "gpl_received"]),
    ("gpl-3.0_terms", "GPL-3.0", ["gpl3_redistribute"]),
    ("gpl-3.0_short", "GPL-3.0", ["gpl3_short"]),
    ("gpl-2.0_notice", "GPL-2.0", ["gpl2_redistribute", "gpl_warranty"]),
    ("gpl-2.0-only_notice", "GPL-2.0", ["gpl2_only", "gpl_warranty"]),
    ("gpl-2.0_terms", "GPL-2.0", ["gpl2_redistribute"]),
    ("gpl-2.0-only_terms", "GPL-2.0", ["gpl2_only"]),
    ("gpl-2.0_short", "GPL-2.0", ["gpl2_short"]),
    ("gpl_short", "GPL", ["gpl_short"]),
    ("lgpl-3.0_notice", "LGPL-3.0", ["lgpl3_redistribute", "lgpl_warranty"]),
    ("lgpl-3.0_terms", "LGPL-3.0", ["lgpl3_redistribute"]),
    ("lgpl-3.0_short", "LGPL-3.0", ["lgpl3_short"]),
    ("lgpl-2.1_notice", "LGPL-2.1", ["lgpl21_redistribute", "lgpl_warranty"]),
    ("lgpl-2.1_terms", "LGPL-2.1", ["lgpl21_redistribute"]),
    ("lgpl-2.1_short", "LGPL-2.1", ["lgpl21_short"]),
    ("agpl-3.0_notice", "AGPL-3.0", ["agpl3_redistribute", "gpl_warranty"]),
    ("agpl-3.0_terms", "AGPL-3.0", ["agpl3_redistribute"]),
    ("agpl-3.0_short", "AGPL-3.0", ["agpl3_short"]),
    ("gfdl_grant", "GFDL", ["gfdl_grant"]),
    ("gfdl_short", "GFDL", ["gfdl_short"]),
    ("mpl-2.0_notice", "MPL-2.0", ["mpl2_notice", "mpl2_copy"]),
    ("mpl-2.0_terms", "MPL-2.0", ["mpl2_notice"]),
    ("mpl-2.0_short", "MPL-2.0", ["mpl2_short"]),
    ("mpl-1.1_notice", "MPL-1.1", ["mpl11_notice"]),
    ("epl-2.0_notice", "EPL-2.0", ["epl2_notice"]),
    ("epl-2.0_short", "EPL-2.0", ["epl2_short"]),
    ("epl-1.0_notice", "EPL-1.0", ["epl1_notice"]),
    ("cddl_notice", "CDDL-1.0", ["cddl_notice", "file_comply"]),
    ("cddl_terms", "CDDL-1.0", ["cddl_notice"]),
    ("eupl-1.2", "EUPL-1.2", ["eupl_short"]),
    ("osl-3.0", "OSL-3.0", ["osl3_short"]),
    ("cecill", "CECILL", ["cecill_notice"]),
    ("sspl-1.0", "SSPL-1.0", ["sspl_short"]),
    ("busl-1.1_grant", "BUSL-1.1", ["busl_short", "busl_grant"]),
    ("busl-1.1_short", "BUSL-1.1", ["busl_short"]),
    ("elastic-2.0", "Elastic-2.0", ["elastic_short"]),
    ("polyform-nc-1.0.0", "PolyForm-Noncommercial-1.0.0", ["polyform_nc_short"]),
    ("cc0-1.0_waiver", "CC0-1.0", ["cc0_waive"]),
    ("cc0-1.0_short", "CC0-1.0", ["cc0_short"]),
    ("cc-by-nc-4.0_short", "CC-BY-NC-4.0", ["ccbync_short"]),
    ("cc-by-nc-sa-4.0_short", "CC-BY-NC-SA-4.0", ["ccbyncsa_short"]),
    ("cc-by-nc-nd-4.0_short", "CC-BY-NC-ND-4.0", ["ccbyncnd_short"]),
    ("cc-by-sa-4.0_short", "CC-BY-SA-4.0", ["ccbysa_short"]),
    ("cc-by-sa-3.0_short", "CC-BY-SA-3.0", ["ccbysa3_short"]),
    ("cc-by-nd-4.0_short", "CC-BY-ND-4.0", ["ccbynd_short"]),
    ("cc-by-4.0_short", "CC-BY-4.0", ["ccby_short"]),
    ("cc-by-3.0_short", "CC-BY-3.0", ["ccby3_short"]),
    ("odbl-1.0", "ODbL-1.0", ["odbl_short"]),
    ("odc-by-1.0", "ODC-By-1.0", ["odcby_short"]),
    ("ogl-uk-3.0", "OGL-UK-3.0", ["ogl_uk_short"]),
    ("ofl-1.1", "OFL-1.1", ["ofl_short"]),
    ("confidential", "Proprietary", ["confidential"]),
    ("all_rights", "Proprietary", ["rights"]),
    ("public_domain", "Public-domain", ["public_domain"]),
]
