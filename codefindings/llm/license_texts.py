"""Texts and notices whose digests are known, and spellings that count as equal."""

from __future__ import annotations

import re
from pathlib import Path

TEXTS = {
    'MIT': '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.''',
    'MIT-0': '''Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.''',
    'ISC': '''Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.''',
    '0BSD': '''Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.''',
    'BSD-2-Clause': '''Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.''',
    'BSL-1.0': '''Boost Software License - Version 1.0 - August 17th, 2003

Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:

The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.''',
    'Zlib': '''This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution.''',
}

#: Longer licences, a file each; a name may go on with ~ and a number for another wording.
FILES = Path(__file__).with_name('license_files')

#: Headings put before the texts that have none of their own.
TITLES = {
    '0BSD': ['BSD Zero Clause License', 'Zero-Clause BSD', 'Zero-Clause BSD License'],
    'BSD-2-Clause': ['BSD 2-Clause License', 'The BSD 2-Clause License', 'The 2-Clause BSD License', 'Simplified BSD License',
                     'BSD 2-Clause "Simplified" License'],
    'BSD-3-Clause': ['BSD 3-Clause License', 'The BSD 3-Clause License', 'The 3-Clause BSD License', 'New BSD License',
                     'BSD 3-Clause "New" or "Revised" License', 'BSD License', 'The BSD License'],
    'BSL-1.0': ['Boost Software License', 'Boost Software License - Version 1.0', 'Boost Software License - Version 1.0 - August 17th, 2003'],
    'ISC': ['ISC License', 'The ISC License', 'ISC License (ISC)'],
    'MIT': ['MIT License', 'The MIT License', 'The MIT License (MIT)', 'MIT License (MIT)', 'MIT'],
    'MIT-0': ['MIT No Attribution', 'MIT No Attribution License', 'MIT-0'],
    'Unlicense': ['Unlicense', 'The Unlicense', 'The Unlicense (Unlicense)'],
    'Zlib': ['zlib License', 'The zlib License', 'zlib/libpng License', 'Zlib'],
}
#: Paragraphs of heading at the start of the files, 1 unless given.
HEADS = {'BSD-3-Clause': 0, 'Unlicense': 0, 'CC0-1.0': 2, 'CC-BY-SA-4.0': 2, 'GPL-2.0~2': 2, 'GPL-3.0~2': 2}


def whole_texts() -> list[tuple[str, str]]:
    """(license, text) of every known licence in its usual forms, sorted.

    With and without heading, and as far as the text has them: with and without the pages after its
    end, http or https in links, the copyright line to fill in or gone, items numbered or not, lines
    broken or one a paragraph.
    """
    out = set()
    for name, text in [*TEXTS.items(), *((f.stem, f.read_text()) for f in sorted(FILES.glob('*.txt')))]:
        license = name.split('~')[0]
        text = text.replace('\f', '\n').strip()
        paragraphs = re.split(r'\n\s*\n', text)
        heads = HEADS.get(name, 1) if name not in TEXTS else 0
        forms = {'\n\n'.join(paragraphs[n:]) for n in range(heads + 1)}
        forms |= {f'{title}\n\n{text}' for title in TITLES.get(license, [])}
        forms |= {part for f in forms for part in _ends(f)}
        forms |= {f.replace('http://', 'https://') for f in forms} | {f.replace('https://', 'http://') for f in forms}
        forms |= {re.sub(r'(?m)^.*[\[{<]yyyy[\]}>].*$', '', f) for f in forms}
        if license.startswith('BSD-'):
            forms |= {re.sub(r'(?m)^ *[0-9]\. +', '', f) for f in forms}
        forms |= {'\n\n'.join(' '.join(p.split()) for p in re.split(r'\n\s*\n', f)) for f in forms}
        out |= {(license, f) for f in forms}
    return sorted(out)


def _ends(text: str) -> list[str]:
    """The text up to and with its closing line, and up to that line, if it has one."""
    end = re.search(r'(?m)^.*END OF TERMS AND CONDITIONS.*$', text)
    return [text[:end.end()], text[:end.start()]] if end else []


NAMES = {
    'Apache-2.0': ['Apache License, Version 2.0', 'Apache License 2.0', 'Apache-2.0'],
    'BSD-2-Clause': ['BSD 2-Clause License', 'BSD-2-Clause'],
    'BSD-3-Clause': ['BSD 3-Clause License', 'BSD-3-Clause', 'BSD License'],
    'CC0-1.0': ['CC0 1.0', 'CC0-1.0'],
    'CC-BY-4.0': ['CC BY 4.0', 'CC-BY-4.0', 'Creative Commons Attribution 4.0 International License'],
    'CC-BY-SA-4.0': ['CC BY-SA 4.0', 'CC-BY-SA-4.0', 'Creative Commons Attribution-ShareAlike 4.0 International License'],
    'CC-BY-NC-4.0': ['CC BY-NC 4.0', 'CC-BY-NC-4.0', 'Creative Commons Attribution-NonCommercial 4.0 International License'],
    'CC-BY-ND-4.0': ['CC BY-ND 4.0', 'CC-BY-ND-4.0'],
    'GPL-2.0': ['GNU General Public License, version 2', 'GPL-2.0', 'GPLv2'],
    'GPL-3.0': ['GNU General Public License, version 3', 'GPL-3.0', 'GPLv3'],
    'GPL': ['GNU General Public License', 'GPL'],
    'AGPL-3.0': ['GNU Affero General Public License, version 3', 'AGPL-3.0', 'AGPLv3'],
    'LGPL-3.0': ['GNU Lesser General Public License, version 3', 'LGPL-3.0', 'LGPLv3'],
    'ISC': ['ISC License', 'ISC'],
    'MIT': ['MIT License', 'MIT'],
    'MPL-2.0': ['Mozilla Public License, Version 2.0', 'MPL-2.0', 'MPL 2.0'],
    'Unlicense': ['Unlicense', 'The Unlicense'],
    'Zlib': ['zlib License', 'Zlib'],
}

FRAMES = ['{}', 'Licensed under {}', 'Licensed under the {}', 'Released under {}', 'Released under the {}',
          'Distributed under {}', 'Distributed under the {}', 'This work is licensed under {}',
          'This work is licensed under the {}', 'This file is licensed under the {}', 'SPDX-License-Identifier: {}',
          'License: {}', 'Available under the {}', 'This software is released under the {}']

#: Applied in this order to lower-case words separated by single blanks.
EQUAL = [
    ('licenc', 'licens'), ('sub licens', 'sublicens'), ('organis', 'organiz'), ('authoris', 'authoriz'),
    ('recognis', 'recogniz'), ('utilis', 'utiliz'), ('acknowledgement', 'acknowledgment'),
    ('judgement', 'judgment'), ('favour', 'favor'), ('honour', 'honor'), ('colour', 'color'),
    ('behaviour', 'behavior'), ('centre', 'center'), ('programme ', 'program '), ('artefact', 'artifact'),
    ('catalogue', 'catalog'), ('analogue', 'analog'), ('fulfill', 'fulfil'), ('wilful', 'willful'),
    ('whilst', 'while'), ('per cent', 'percent'), ('non commercial', 'noncommercial'),
    ('non infringement', 'noninfringement'), ('copyright owner', 'copyright holder'),
    ('third parties', 'third party'),
]
