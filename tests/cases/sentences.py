"""Sentences with the quantities they state, written for these tests."""

from __future__ import annotations

QUANTITIES = [
    ("The rescue flight is paid up to INR 3,40,000 a trip", [(340000, "INR")]),
    ("Rs. 900 a night, at most Rs 7,200", [(900, "INR"), (7200, "INR")]),
    ("Each visit costs `650 or less", [(650, "INR")]),
    ("A budget of ₹4.5 lakh", [(450000, "INR")]),
    ("They set aside `31 cr. over 12 years", [(310000000, "INR"), (12, "YEARS")]),
    ("grades 140 35%", [(140, "COUNT"), (35, "PERCENT")]),
    ("3 Lacs, 4.5 Lacs, 9 Lacs", [(300000, "INR"), (450000, "INR"), (900000, "INR")]),
    ("a limit from INR 4/6/8 Lakhs.", [(400000, "INR"), (600000, "INR"), (800000, "INR")]),
    ("2L/ 3L/ 4L", [(200000, "INR"), (300000, "INR"), (400000, "INR")]),
    ("from INR 2 lacs to INR 3 crores", [(200000, "INR"), (30000000, "INR")]),
    ("INR. 8,500 in all", [(8500, "INR")]),
    ("A rebate of 17% applies", [(17, "PERCENT")]),
    ("a wait of 18 months", [(18, "MONTHS")]),
    ("after 45 days", [(45, "DAYS")]),
    ("a stay of 72 hrs. or longer", [(72, "HOURS")]),
    ("answers in 45 Mins", [(0.75, "HOURS")]),
    ("4X: the unused part is kept", [(4, "MULTIPLIER")]),
    ("2X / 4X / 8X of the base", [(2, "MULTIPLIER"), (4, "MULTIPLIER"), (8, "MULTIPLIER")]),
    ("up to 3 times the base", [(3, "MULTIPLIER")]),
    ("cut to 2 or 3 years", [(2, "YEARS"), (3, "YEARS")]),
    ("15-25% of the bill", [(15, "PERCENT"), (25, "PERCENT")]),
    ("3 Crore+ lives so far", [(30000000, "COUNT")]),
    ("2.5 cr. people", [(25000000, "COUNT")]),
    ("8,000+ clinics", [(8000, "COUNT")]),
    ("Day 1 help for 5 listed needs", [(1, "DAYS"), (5, "COUNT")]),
    ("Past the 2 nd year it doubles by 100%", [(2, "YEARS"), (100, "PERCENT")]),
    ("Grown-up: 21 years Infant: 60 days", [(21, "YEARS"), (60, "DAYS")]),
    ("two adults at most: 2A3C", [(2, "COUNT"), (3, "COUNT")]),
    ("₹75,000", [(75000, "INR")]),
    ("Rs75000", [(75000, "INR")]),
    ("20% off for 240 healthy days", [(20, "PERCENT"), (240, "DAYS")]),
    ("a pair, ages 41 & 39, ₹8L base", [(41, "YEARS"), (39, "YEARS"), (800000, "INR")]),
    ("₹2, 3.5, 6 and 60 lakh", [(200000, "INR"), (350000, "INR"), (600000, "INR"), (6000000, "INR")]),
    ("terms of 1, 2 or 3 years", [(1, "YEARS"), (2, "YEARS"), (3, "YEARS")]),
    ("between ₹15,000 and ₹2 lakh", [(15000, "INR"), (200000, "INR")]),
    ("6.5% in year 1 and 4% in year 3", [(6.5, "PERCENT"), (1, "YEARS"), (4, "PERCENT"), (3, "YEARS")]),
    ("a ₹1.5-lakh flight", [(150000, "INR")]),
    ("from ₹1+ crore on", [(10000000, "INR")]),
    ("5 to 15 per cent", [(5, "PERCENT"), (15, "PERCENT")]),
    ("a 6-fold sum, later 8×", [(6, "MULTIPLIER"), (8, "MULTIPLIER")]),
    ("₹300K, or 12k steps", [(300000, "INR"), (12000, "COUNT")]),
    ("48 mos of waiting", [(48, "MONTHS")]),
    ("covers 412 day care items", [(412, "COUNT")]),
    ("₹700 per day/₹4,900 max", [(700, "INR"), (4900, "INR")]),
    ("45 days pre/90 days post", [(45, "DAYS"), (90, "DAYS")]),
    ("Level 3 - 25% off", [(25, "PERCENT")]),
    ("up to ₹400, 800 or 1600 a visit", [(400, "INR"), (800, "INR"), (1600, "INR")]),
    ("250000 rupees, or INR 18,240/-", [(250000, "INR"), (18240, "INR")]),
    ("the 9th year may differ", [(9, "YEARS")]),
    ("1. Up to 3 visits in all, `450 each 2. Up to 6 calls", [(3, "COUNT"), (450, "INR"), (6, "COUNT")]),
    *[
        (text, [])
        for text in (
            "Base Sum7",
            "Check(3)",
            "UIN: QXZPLMN41022V071819",
            "Reg. No. 512.",
            "ring 1800-222-3333",
            "ring 040 5151 5151",
            "Pune-411001",
            "24X7 help desk",
            "as of 4th June 2023.",
            "Prizes 2021",
            "Zone 3: the south",
            "form 7ABC",
            "QZ/AB/2021-22/077.",
            "the 3rd Floor",
            "Nagpur - 440 022.",
            "see List 2, 3 and 4 of it",
            "Fax: +44 20 71234567",
            "max.8 visits",
            "won it in the year 2022",
        )
    ],
]

CLAIMED = [
    ("Fax: +44 20 71234567", [(44, "COUNT"), (20, "COUNT"), (71234567, "COUNT")]),
    ("max.8 visits", [(8, "COUNT")]),
    ("Check(3)", [(3, "COUNT")]),
    ("2100 steps", [(2100, "COUNT")]),
    ("Zone 3", []),
    ("Starplan 3.5", []),
    ("Starplan 3.5 pays up to ₹3.5 lakh", [(350000, "INR")]),
    ("grown since 2021", []),
    ("24x7 help for 4 members", [(4, "COUNT")]),
]

PRODUCTS = r"(?i)(?<![A-Za-z0-9])Starplan 3\.5(?![0-9])"
