"""Lines written by hand, spans of personal data marked as {kind:...}; not made by the operator's generator
and never used for fitting or tuning."""

import re

LINES = r"""
Please write to {email:j.smith @ firm.co.uk} before Friday.
Our office: {email:helpdesk [at] town-hall.gov.uk}. Then wait for an answer.
You reach Jane under {email:jane dot doe at example dot org} most days.
Contact {email:m.keller(at)uni-mainz.de}, not the dean.
Send drafts to {email:press (at) museum (dot) nl} or by post.
His old address was {email:otto.brandt@post.ch} and it still works.
{email:sales [at] north-bikes [dot] com} answers within a day
Reply to {email:k_ivanova [AT] mail [DOT] ru} please.
The list owner is {email:editor @ journal.org}, she reads everything.
Mail {email:anna @ dept.physics.uni.edu} about the seminar.
Ring {phone:020 7946 0958} and ask for Tom.
Appelez le {phone:06 12 34 56 78} apres midi.
tel {phone:555-0134} after six
Phone: {phone:(212) 555-0187}, ask for the night desk.
Call {phone:+44 20 7946 0018} from abroad.
My mobile is {phone:07700 900461} now.
Fax {phone:030 1234567} works too.
In the US dial {phone:1-800-555-0199} for help.
Numer: {phone:0048 601 234567} czynny do osiemnastej.
Reservations under {phone:415.555.0132} only.
The card {card:4111 1111 1111 1111} was declined twice.
Visa {card:4012.8888.8888.1881} is on file.
She read out {card:5500/0000/0000/0004} over the phone.
Amex {card:378282246310005} expires in May.
The server sits at {ip:192.0.2.146} behind a proxy.
Traffic came from {ip:203[.]0[.]113[.]77} all night.
Block {ip:198.51.100[.]23} at the gateway.
We saw {ip:10[dot]0[dot]14[dot]2} in the logs.
Host 192.168.1.300 is not an address.
Room 12-34 opens at 10.30, lunch is at 12.45 in hall 7.
Born 1984-03-22, moved 1999, retired 2021-11-30.
ISBN 978-3-16-148410-0 is out of print.
Order 20230114 000217 has shipped with 3 parcels.
Look at polka dot dresses in the window.
We met @ 9.30 and sold apples @ 2.50 each.
Between 1914-1918 prices rose from 100 to 330 000 marks.
Version 2.14.7 replaced 2.9.1 on 03/05/2019.
Card 4111 1111 1111 1112 is a test that fails its checksum.
The lottery drew 12 24 31 36 41 and 48 last night.
Population: 1 204 311 in 1960 and 2 005 118 in 2000.
Coordinates 52.5200 13.4050 mark the gate.
She stopped at every red dot on the map.
The score was 21-19, 18-21, 21-17 after two hours.
Article 12.3.4 applies, see pages 110-118.
He paid 1299.00 on 12.04.2018 for it.
Serial 00417-88213 is stamped below.
"""

#: Written after the generators and plants were settled, before they were run on any of these.
LATER = r"""
Questions go to {email:ilse.vos [at] waterboard.nl} by noon.
Ask {email:bob dot marsh at cs dot uni dot edu} for the slides.
{email:office(at)harbour(dot)org} is read once a day.
Booking: {email:rooms @ hotel-linde.ch}. No calls.
Write {email:t_oneill [AT] press.ie} with corrections.
Dial {phone:0161 496 0753} for the shop.
Telefon {phone:0221/4710815} ab neun Uhr.
Mobile {phone:0470 12 34 56} evenings only.
Call {phone:555-0178} and leave word.
Or phone {phone:312-555-0146} first.
Charge it to {card:6011.1111.1111.1117} as before.
The bot used {ip:172[.]16[.]254[.]3} twice.
Beacon to {ip:192 . 0 . 2 . 33} at dawn.
Scores: 14 22 31 9, then 18 25 30 12.
They stood at the last dot on a dark screen.
Sold @ 14.20 and again @ 15.05 that day.
Address 299.12.400.7 cannot exist.
Lot 4471-208 went for 12 500 in 1987.
The years 1848-1871 fill chapter 7.
Flight 2231 left at 18.45 from gate 14.
"""


def cases(lines: str = LINES) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, spans by place) of each line."""
    out = []
    for line in lines.strip().split("\n"):
        text, spans, at = "", [], 0
        for m in re.finditer(r"\{(email|ip|card|phone):([^}]*)\}", line):
            text += line[at : m.start()]
            spans.append((m[1], len(text), len(text) + len(m[2])))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], spans))
    return out
