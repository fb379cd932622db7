"""Licence texts and notices that the licence scan looks for.

Fixed values. Each template has a label, its whole text, and the phrases of
that text that a file must hold for the label.
"""

from __future__ import annotations

from typing import NamedTuple


class Template(NamedTuple):
    name: str
    label: str
    text: str
    mandatory: tuple[str, ...]


AS_IS = (
    "The software is provided \"as is\", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, "
    "fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, "
    "whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software."
)
HOLDERS = (
    "This software is provided by the copyright holders and contributors \"as is\" and any express or implied warranties, including, but not limited to, the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, "
    "indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, "
    "or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) "
    "arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
ENDORSE = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
NO_WARRANTY = (
    " is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
)


def gnu(name: str, version: str, what: str = "This program") -> str:
    """The notice that the GNU licences ask for."""
    return (
        f"{what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
        f"either version {version} of the License, or (at your option) any later version. {what}{NO_WARRANTY}"
        f"See the {name} for more details. You should have received a copy of the {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
    )


GPL, LGPL, AGPL = "GNU General Public License", "GNU Lesser General Public License", "GNU Affero General Public License"

TEMPLATES = (
    Template(
        "MIT", "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. " + AS_IS,
        ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "shall be included in all copies or substantial portions of the software"),
    ),
    Template("MIT notice", "mit", "Released under the MIT License.", ("released under the mit license",)),
    Template(
        "ISC", "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
        "permission notice appear in all copies. The software is provided \"as is\" and the author disclaims all warranties with regard to this software including all implied warranties "
        "of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from "
        "loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.",
        ("for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",),
    ),
    Template(
        "0BSD", "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. The software is provided \"as is\" and the author "
        "disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness.",
        ("for any purpose with or without fee is hereby granted the software is provided as is",),
    ),
    Template("BSD-2-Clause", "bsd", REDISTRIBUTION + HOLDERS, ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions in binary form must reproduce the above copyright notice")),
    Template(
        "BSD-3-Clause", "bsd-3-clause", REDISTRIBUTION + ENDORSE + HOLDERS,
        ("redistribution and use in source and binary forms with or without modification are permitted", "redistributions in binary form must reproduce the above copyright notice", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ),
    Template(
        "Apache-2.0 notice", "apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        ("licensed under the apache license version 2 0", "you may not use this file except in compliance with the license"),
    ),
    Template("Apache short notice", "apache", "Licensed under the Apache License, Version 2.0.", ("licensed under the apache license",)),
    Template("GPL notice", "gpl", gnu(GPL, "3"), ("it under the terms of the gnu general public license as published by the free software foundation",)),
    Template("GPL short notice", "gpl", f"This work is licensed under the {GPL}, version 3.", ("licensed under the gnu general public license",)),
    Template("LGPL notice", "lgpl", gnu(LGPL, "3", "This library"), ("it under the terms of the gnu lesser general public license as published by the free software foundation",)),
    Template("AGPL notice", "agpl", gnu(AGPL, "3"), ("it under the terms of the gnu affero general public license as published by the free software foundation",)),
    Template(
        "MPL-2.0 notice", "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("this source code form is subject to the terms of the mozilla public license",),
    ),
    Template(
        "zlib", "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the "
        "product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution.",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
    ),
    Template(
        "BSL-1.0", "boost",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, "
        "reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, "
        "all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be "
        "included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable "
        "object code generated by a source language processor.",
        ("to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",),
    ),
    Template(
        "Unlicense", "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and "
        "all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this "
        "dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + AS_IS,
        ("this is free and unencumbered software released into the public domain",),
    ),
    Template(
        "WTFPL", "wtfpl",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. "
        "Do what the fuck you want to public license. Terms and conditions for copying, distribution and modification. 0. You just do what the fuck you want to.",
        ("do what the fuck you want to public license",),
    ),
    Template("CC0-1.0 notice", "cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal.", ("has waived all copyright and related or neighboring rights",)),
    Template("CC-BY-4.0 notice", "cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ("creative commons attribution 4 0 international",)),
    Template("CC-BY-4.0 short notice", "cc-by", "Licensed under CC BY 4.0.", ("licensed under cc by 4 0",)),
    Template("CC-BY-SA-4.0 notice", "cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ("creative commons attribution sharealike 4 0 international",)),
    Template("CC-BY-NC-4.0 notice", "cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ("creative commons attribution noncommercial 4 0 international",)),
    Template("CC-BY-NC-4.0 short notice", "cc-by-nc", "Licensed under CC BY-NC 4.0.", ("licensed under cc by nc 4 0",)),
    Template("all rights reserved", "all-rights-reserved", "All rights reserved.", ("all rights reserved",)),
)
