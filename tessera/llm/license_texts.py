"""Templates of license scans: phrases that name a licence, headers of source files, and texts of licence files."""

from __future__ import annotations

#: Identifiers of licences and the names by which works refer to them.
NAMES = {
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "Apache-2.0": "Apache License, Version 2.0",
    "BSD-2-Clause": "BSD 2-Clause License",
    "BSD-3-Clause": "BSD 3-Clause License",
    "BSL-1.0": "Boost Software License, Version 1.0",
    "CC-BY-4.0": "CC BY 4.0",
    "CC-BY-NC-4.0": "CC BY-NC 4.0",
    "CC-BY-SA-4.0": "CC BY-SA 4.0",
    "CC0-1.0": "CC0 1.0 Universal",
    "EPL-2.0": "Eclipse Public License, version 2.0",
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-3.0": "GNU General Public License, version 3",
    "ISC": "ISC License",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "MIT": "MIT License",
    "MPL-2.0": "Mozilla Public License, version 2.0",
    "Unlicense": "Unlicense",
    "Zlib": "zlib License",
}
#: How works say that they are under a licence.
PHRASES = ("{name}", "Licensed under the {name}.", "Released under the {name}.", "This work is licensed under the {name}.", "This file is distributed under the terms of the {name}.", "SPDX-License-Identifier: {id}")

#: The paragraphs of headers and licence texts that tell a licence from others.
_GPL = "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation{comma} either version {n} of the License, or (at your option) any later version."
_REDISTRIBUTION = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_CLAUSES = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
_ENDORSE = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_NO_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
    "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
)
_MIT_REST = (
    "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
TEXTS = {
    "AGPL-3.0": [_GPL.format(what="program", colon=":", kind="Affero General", comma=",", n="3")],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["BSD 2-Clause License Copyright (c) year, holder " + _REDISTRIBUTION + _CLAUSES + _NO_WARRANTY],
    "BSD-3-Clause": ["BSD 3-Clause License Copyright (c) year, holder " + _REDISTRIBUTION + _CLAUSES + _ENDORSE + _NO_WARRANTY, _ENDORSE],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"],
    "GPL-2.0": [_GPL.format(what="program", colon=";", kind="General", comma=";", n="2")],
    "GPL-3.0": [_GPL.format(what="program", colon=":", kind="General", comma=",", n="3")],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-2.1": [_GPL.format(what="library", colon=";", kind="Lesser General", comma=";", n="2.1")],
    "LGPL-3.0": [_GPL.format(what="library", colon=":", kind="Lesser General", comma=",", n="3")],
    "MIT": ["MIT License Copyright (c) year holder " + _MIT_GRANT + _MIT_REST, _MIT_GRANT, _MIT_REST],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."],
}


def templates() -> list[tuple[str, str]]:
    """(licence, text) of all templates."""
    phrases = [(key, p.format(name=name, id=key)) for key, name in NAMES.items() for p in PHRASES]
    return sorted({*phrases, *((key, text) for key, texts in TEXTS.items() for text in texts)})
