"""License texts, standard headers and usual wordings, by name."""

from __future__ import annotations

import pkgutil

_FULL = "Apache-2.0 Artistic-1.0 BSD-3-Clause CC0-1.0 GFDL-1.2 GFDL-1.3 GPL-1.0 GPL-2.0 GPL-3.0 LGPL-2.0 LGPL-2.1 LGPL-3.0 MPL-1.1 MPL-2.0".split()

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_MIT = f"Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"
_BSD_2 = 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
_UNLICENSE = "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
_APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."


def _gnu(kind: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


def _gnu_only(kind: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {kind} Public License version {version} as published by the Free Software Foundation."


_HEADERS = (
    ("MIT", _MIT),
    ("BSD-2-Clause", _BSD_2),
    ("ISC", _ISC),
    ("Unlicense", _UNLICENSE),
    ("Apache-2.0", _APACHE),
    *((f"{short}-{v}.0" if "." not in v else f"{short}-{v}", form(kind, v, what)) for form in (_gnu, _gnu_only) for short, kind, versions, what in (("GPL", "General", ("2", "3"), "program"), ("LGPL", "Lesser General", ("2.1", "3"), "library"), ("AGPL", "Affero General", ("3",), "program")) for v in versions),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)

_VERBS = ("Licensed", "Distributed", "Available")
_CC = (("CC-BY", "Attribution", "CC BY"), ("CC-BY-SA", "Attribution-ShareAlike", "CC BY-SA"), ("CC-BY-ND", "Attribution-NoDerivatives", "CC BY-ND"), ("CC-BY-NC", "Attribution-NonCommercial", "CC BY-NC"), ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike", "CC BY-NC-SA"), ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives", "CC BY-NC-ND"))

_WORDINGS = (
    *(("MIT", f"{v} under the MIT License") for v in _VERBS),
    *((name, f"{v} under the {wording}") for v in _VERBS for name, wording in (
        ("MIT", "terms of the MIT License"), ("Apache-2.0", "Apache License 2.0"), ("Apache-2.0", "Apache License, Version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
        ("ISC", "ISC License"), ("MPL-2.0", "Mozilla Public License 2.0"), ("EPL-2.0", "Eclipse Public License 2.0"),
        *((f"{short}-{n}", f"GNU {kind} Public License {v}") for short, kind, versions in (("GPL", "General", ("2.0", "3.0")), ("LGPL", "Lesser General", ("2.1", "3.0")), ("AGPL", "Affero General", ("3.0",))) for n in versions for v in (f"v{n}", f"v{n.removesuffix('.0')}", f"version {n.removesuffix('.0')}")),
    )),
    *((f"{name}-{v}", f"This work is licensed under a Creative Commons {long} {v} International License") for name, long, _ in _CC for v in ("4.0",)),
    *((f"{name}-3.0", f"This work is licensed under a Creative Commons {long} 3.0 Unported License") for name, long, _ in _CC),
    *((f"{name}-{v}", f"Licensed under {short} {v}") for name, _, short in _CC for v in ("3.0", "4.0")),
    *((name, f"SPDX-License-Identifier: {name}{tail}") for name in (*_FULL, "MIT", "ISC", "BSD-2-Clause", "AGPL-3.0", "EPL-2.0", "Unlicense", *(f"{n}-4.0" for n, *_ in _CC)) for tail in (("", "-only", "-or-later") if "GPL" in name else ("",))),
)


def full_texts() -> list[tuple[str, str]]:
    """The texts in license_texts, from a folder or a zip."""
    return [(name, pkgutil.get_data(__package__, f"license_texts/{name}.txt").decode("utf-8")) for name in _FULL]


TABLE = (*full_texts(), *_HEADERS, *_WORDINGS)
