"""Wording of licences and of the notices by which files name them: public texts, as (label, words, mandatory phrases).

Words are lower-cased and without punctuation; names and years are left out, so a copyright line is no part of a template.
"""

from __future__ import annotations


def _words(text: str) -> str:
    return " ".join(text.split())


_WARRANTY = """the software is provided as is without warranty of any kind express or implied including but not limited to the
warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright
holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of
or in connection with the software or the use or other dealings in the software"""
_BSD_TWO = """redistribution and use in source and binary forms with or without modification are permitted provided that the
following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the
following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the
following disclaimer in the documentation and or other materials provided with the distribution"""

# Licence texts and notices.
TEXTS = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license"]),
    ("apache-2.0", """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
     license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed
     to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind
     either express or implied see the license for the specific language governing permissions and limitations under the license""", ["apache license", "except in compliance with the license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", """permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation
     files the software to deal in the software without restriction including without limitation the rights to use copy modify merge
     publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so
     subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or
     substantial portions of the software """ + _WARRANTY, ["permission is hereby granted free of charge", "obtaining a copy of this software"]),
    ("isc", """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
     provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the
     author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no
     event shall the author be liable for any special direct indirect or consequential damages""", ["permission to use copy modify", "distribute this software for any purpose"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use"]),
    ("bsd-2-clause", _BSD_TWO + """ this software is provided by the copyright holders and contributors as is and any express or implied
     warranties""", ["redistribution and use", "redistributions in binary form must reproduce"]),
    ("bsd-3-clause", _BSD_TWO + """ neither the name of the copyright holder nor the names of its contributors may be used to endorse or
     promote products derived from this software without specific prior written permission""", ["redistribution and use", "endorse or promote products"]),
    ("zlib", """this software is provided as is without any express or implied warranty in no event will the authors be held liable for any
     damages arising from the use of this software permission is granted to anyone to use this software for any purpose including
     commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software
     must not be misrepresented""", ["must not be misrepresented", "alter it and redistribute it freely"]),
    ("bsl-1.0", """permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying
     documentation covered by this license the software to use reproduce display distribute execute and transmit the software""", ["obtaining a copy of the software and accompanying documentation"]),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"]),
    ("gpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
     published by the free software foundation either version 3 of the license or at your option any later version""", ["gnu general public license as published", "version 3 of the license"]),
    ("gpl-2.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as
     published by the free software foundation either version 2 of the license or at your option any later version""", ["gnu general public license as published", "version 2 of the license"]),
    ("lgpl-2.1", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
     as published by the free software foundation either version 2 1 of the license or at your option any later version""", ["lesser general public license", "version 2 1"]),
    ("lgpl-3.0", """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license
     as published by the free software foundation either version 3 of the license or at your option any later version""", ["lesser general public license", "version 3 of the license"]),
    ("agpl-3.0", """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license
     as published by the free software foundation either version 3 of the license or at your option any later version""", ["gnu affero general public license", "version 3"]),
    ("mpl-2.0", """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with
     this file you can obtain one at http mozilla org mpl 2 0""", ["mozilla public license"]),
    ("epl-2.0", """this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is
     available at https www eclipse org legal epl 2 0""", ["eclipse public license", "2 0"]),
    ("unlicense", """this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell
     or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
     means""", ["free and unencumbered software", "public domain"]),
    ("wtfpl", "do what the fuck you want to public license everyone is permitted to copy and distribute verbatim or modified copies of this license document", ["what the fuck you want to"]),
    ("cc0-1.0", """the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to
     the work worldwide under copyright law""", ["dedicated the work to the public domain"]),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution 4 0"]),
    ("cc-by-sa-4.0", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ["creative commons attribution sharealike 4 0"]),
    ("cc-by-nc-4.0", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ["creative commons attribution noncommercial 4 0"]),
]
TEMPLATES = [(label, _words(text), phrases) for label, text, phrases in TEXTS]
