"""Wording of public licenses, as fixed values: words in lower case, without punctuation.

``PHRASES`` are names of licenses, ``NOTICES`` whole short licenses and the notices with
which long ones are applied."""

# The phrases of the contract.
BASE_PHRASES = [
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
]
# Names of common public licenses.
PHRASES = [
    ("lgpl", "lesser general public license"),
    ("agpl", "affero general public license"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("isc", "isc license"),
    ("zlib", "zlib license"),
    ("bsl", "boost software license"),
    ("artistic", "artistic license"),
    ("cddl", "common development and distribution license"),
    ("eupl", "european union public licence"),
    ("ofl", "sil open font license"),
    ("cc-by", "creative commons attribution"),
    ("cc0", "cc0 1 0 universal"),
    ("wtfpl", "do what the fuck you want to public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
    "documentation files the software to deal in the software without restriction including without limitation "
    "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"
)
_MIT_NOTICE = (
    "the above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the software"
)
_MIT_DISCLAIMER = (
    "the software is provided as is without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors "
    "or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or "
    "otherwise arising from out of or in connection with the software or the use or other dealings in the software"
)
_BSD_CONDITIONS = (
    "redistribution and use in source and binary forms with or without modification are permitted provided "
    "that the following conditions are met"
)
_BSD_BINARY = (
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the "
    "following disclaimer in the documentation and or other materials provided with the distribution"
)
_BSD_DISCLAIMER = (
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties "
    "including but not limited to the implied warranties of merchantability and fitness for a particular purpose are "
    "disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental "
    "special exemplary or consequential damages including but not limited to procurement of substitute goods or "
    "services loss of use data or profits or business interruption however caused and on any theory of liability "
    "whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use "
    "of this software even if advised of the possibility of such damage"
)
_GPL_WARRANTY = (
    "is distributed in the hope that it will be useful but without any warranty without even the "
    "implied warranty of merchantability or fitness for a particular purpose"
)
# Wording of the licenses and of their notices.
NOTICES = [
    ("mit", _MIT_GRANT),
    ("mit", _MIT_NOTICE),
    ("mit", f"{_MIT_GRANT} and to permit persons to whom the software is furnished to do so subject to the following conditions "
            f"{_MIT_NOTICE} {_MIT_DISCLAIMER}"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in "
               "compliance with the license you may obtain a copy of the license at"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is "
               "distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
            "public license as published by the free software foundation either version"),
    ("gpl", f"this program {_GPL_WARRANTY}"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
             "public license as published by the free software foundation either version"),
    ("lgpl", f"this library {_GPL_WARRANTY}"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
             "public license as published by the free software foundation either version"),
    ("bsd", _BSD_CONDITIONS),
    ("bsd", _BSD_BINARY),
    ("bsd", f"{_BSD_CONDITIONS} 1 redistributions of source code must retain the above copyright notice this list of conditions and "
            f"the following disclaimer 2 {_BSD_BINARY} {_BSD_DISCLAIMER}"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
            "products derived from this software without specific prior written permission"),
    ("bsd", _BSD_DISCLAIMER),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is "
            "hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "the software is provided as is and the author disclaims all warranties with regard to this software including all "
            "implied warranties of merchantability and fitness in no event shall the author be liable for any special direct "
            "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an "
            "action of contract negligence or other tortious action arising out of or in connection with the use or performance "
            "of this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable "
             "for any damages arising from the use of this software permission is granted to anyone to use this software for any "
             "purpose including commercial applications and to alter it and redistribute it freely subject to the following "
             "restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original "
             "software if you use this software in a product an acknowledgment in the product documentation would be appreciated "
             "but is not required 2 altered source versions must be plainly marked as such and must not be misrepresented as being "
             "the original software 3 this notice may not be removed or altered from any source distribution"),
    ("bsl", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
            "accompanying documentation covered by this license the software to use reproduce display distribute execute and "
            "transmit the software and to prepare derivative works of the software and to permit third parties to whom the "
            "software is furnished to do so all subject to the following"),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form "
                  "or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl "
            "was not distributed with this file you can obtain one at"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("ofl", "this font software is licensed under the sil open font license"),
    ("cc-by", "this work is licensed under a creative commons attribution"),
    ("cc-by", "you are free to share copy and redistribute the material in any medium or format"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
