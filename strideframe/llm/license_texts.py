"""Paragraphs of public licences and notices, by label: notices and short licences here, whole licences in ``license_bodies``."""

from __future__ import annotations

import re
from pathlib import Path

# Texts of public licences.
_TEXTS = {
    "mit": """
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction
""",
    "isc": """
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.
""",
    "bsd": """
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.
""",
    "apache": """
Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.
Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership. The ASF licenses this file to you under the Apache License, Version 2.0
Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.
""",
    "gpl": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program.
The GNU General Public License is a free, copyleft license for software and other kinds of works.
""",
    "lgpl": """
This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.
This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.
""",
    "agpl": """
This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
You should have received a copy of the GNU Affero General Public License along with this program.
""",
    "mpl": """
This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
""",
    "epl": """
This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at
""",
    "zlib": """
This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
The origin of this software must not be misrepresented; you must not claim that you wrote the original software.
""",
    "boost": """
Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
Distributed under the Boost Software License, Version 1.0.
""",
    "unlicense": """
This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
""",
    "cc-by": """
This work is licensed under a Creative Commons Attribution 4.0 International License.
This work is licensed under a Creative Commons Attribution 3.0 Unported License.
""",
    "cc-by-sa": """
This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.
""",
    "cc-by-nc": """
This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
""",
    "cc-by-nd": """
This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.
""",
    "cc0": """
To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.
The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law, including all related and neighboring rights, to the extent allowed by law.
""",
}
# Files of whole licences (in ``license_bodies``) and their labels.
_BODIES = {
    "Apache-2.0": "apache", "Artistic": "artistic", "CC0-1.0": "cc0", "GFDL-1.3": "gfdl", "GPL-2": "gpl", "GPL-3": "gpl",
    "LGPL-2.1": "lgpl", "LGPL-3": "lgpl", "MPL-1.1": "mpl", "MPL-2.0": "mpl",
}
LEAST_WORDS = 8  # of a paragraph of a whole licence; shorter ones are headings


def _templates() -> list[tuple[str, str]]:
    """Notices, the short names of the Creative Commons licences, and the paragraphs of whole licences; a label has each text once."""
    out = [(label, paragraph) for label, text in _TEXTS.items() for paragraph in text.strip().split("\n")]
    out += [(f"cc-{kind.lower()}", f"CC {kind} {version}") for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("1.0", "2.0", "2.5", "3.0", "4.0")]
    for name, label in _BODIES.items():
        body = (Path(__file__).parent / "license_bodies" / f"{name}.txt").read_text("utf-8")
        out += [(label, " ".join(paragraph.split())) for paragraph in re.split(r"\n\s*\n", body) if len(paragraph.split()) >= LEAST_WORDS]
    return list(dict.fromkeys(out))


TEMPLATES = _templates()
