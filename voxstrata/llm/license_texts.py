"""Public licence notices and paragraphs of licence texts, by family."""

from __future__ import annotations

# Short notices as people write them.
NOTICES: dict[str, tuple[str, ...]] = {
    "agpl-3.0": ("licensed under the gnu affero general public license version 3", "gnu agpl v3 or later", "released under the agpl 3.0"),
    "apache-2.0": ("licensed under the apache license, version 2.0", "released under the apache 2.0 license", "this project uses the apache license 2.0", "spdx license identifier apache 2.0"),
    "bsd": ("licensed under the bsd 3 clause license", "released under the bsd 2 clause license", "distributed under a bsd style license", "use of this source code is governed by a bsd style license that can be found in the license file", "this work is licensed under the bsd license"),
    "cc-by-4.0": ("licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"),
    "cc-by-nc-4.0": ("licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license", "for non commercial use only under cc by-nc 4.0"),
    "cc-by-sa-4.0": ("licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    "cc0-1.0": ("released under cc0 1.0", "to the extent possible under law the author has waived all copyright to this work", "dedicated to the public domain under cc0"),
    "gpl-2.0": ("licensed under the gnu general public license, version 2", "released under the gpl v2", "this work is licensed under the gnu general public license version 2"),
    "gpl-3.0": ("this work is licensed under the gnu general public license, version 3", "licensed under the gnu gpl version 3 or later", "released under the gpl v3"),
    "isc": ("released under the isc license", "licensed under the isc license"),
    "lgpl": ("released under the lgpl", "licensed under the lgpl"),
    "lgpl-2.1": ("licensed under the gnu lesser general public license version 2.1", "released under the lgpl v2.1"),
    "lgpl-3.0": ("licensed under the gnu lesser general public license, version 3", "released under the lgpl v3"),
    "mit": ("released under the mit license", "licensed under the mit license", "this project is mit licensed", "spdx license identifier mit"),
    "mpl-2.0": ("licensed under the mozilla public license, version 2.0", "released under the mpl 2.0", "subject to the terms of the mozilla public license v 2.0"),
    "proprietary": ("all rights reserved", "copyright all rights reserved", "no part of this publication may be reproduced without permission", "unauthorized copying of this file is strictly prohibited proprietary and confidential"),
    "unlicense": ("released under the unlicense", "this is free and unencumbered software released into the public domain"),
}

# Paragraphs of the licences and of their standard file headers.
# Paragraphs that several families share word for word are left out, as they don't tell which it is.
PARAGRAPHS: dict[str, tuple[str, ...]] = {
    "agpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU Affero General Public License is a free, copyleft license for software and other kinds of works, specifically designed to ensure cooperation with the community in the case of network server software.",
    ),
    "apache-2.0": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    ),
    "cc-by-4.0": ('This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/',),
    "cc-by-nc-4.0": ('This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-nc/4.0/',),
    "cc-by-sa-4.0": ('This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by-sa/4.0/',),
    "cc0-1.0": ("To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",),
    "gpl-2.0": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
        "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software--to make sure the software is free for all its users.",
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER',
    ),
    "lgpl-2.1": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "lgpl-3.0": (
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit": (
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "If it is impossible or undesirable to put the notice in a particular file, then You may include the notice in a location (such as a LICENSE file in a relevant directory) where a recipient would be likely to look for such a notice.",
    ),
    "proprietary": ("This software contains confidential and proprietary information. You shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement you entered into.",),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain.",
    ),
}
