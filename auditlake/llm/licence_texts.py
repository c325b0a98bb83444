"""Words of well-known licences and of the short notices that name them, by label."""

# Published licence texts and notices, without their copyright lines.
_WARRANTY = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT
LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""

_BSD_CLAUSES = """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright
notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the
above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other
materials provided with the distribution."""

_GNU_NOTICE = """This program is free software: you can redistribute it and/or modify it under the terms of the {name}
as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {name} for more details."""

#: Whole texts or notices by label.
TEMPLATES: dict[str, list[str]] = {
    "mit": [
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
        to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice shall be included in all copies or substantial portions of the
        Software. """ + _WARRANTY,
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache": [
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless
        required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the
        specific language governing permissions and limitations under the License.""",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        _GNU_NOTICE.format(name="GNU General Public License", version=3),
        _GNU_NOTICE.format(name="GNU General Public License", version=2),
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU GPL",
    ],
    "lgpl": [
        _GNU_NOTICE.format(name="GNU Lesser General Public License", version=3),
        "Licensed under the GNU Lesser General Public License",
    ],
    "agpl": [
        _GNU_NOTICE.format(name="GNU Affero General Public License", version=3),
        "Licensed under the GNU Affero General Public License",
    ],
    "bsd": [
        _BSD_CLAUSES,
        _BSD_CLAUSES + """ 3. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission.""",
        "Licensed under the BSD License",
    ],
    "isc": [
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    ],
    "mpl": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was
        not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        "Licensed under the Mozilla Public License, version 2.0",
    ],
    "unlicense": [
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
        purpose, commercial or non-commercial, and by any means.""",
    ],
    "zlib": [
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software
        for any purpose, including commercial applications, and to alter it and redistribute it freely.""",
    ],
    "boost": ["Distributed under the Boost Software License, Version 1.0"],
    "cc-by": ["Licensed under CC BY 4.0", "licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"],
}

#: Phrases that make a label wherever their words stand one after the other.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
