"""Numbers of sixty and more countries, judged by hand from the public plans."""

# Calling code -> a number that is valid there, one that is not. Fixed values.
BY_HAND = {
    "1": ("212 555 0123", "112 555 0123"), "7": ("495 123-45-67", "195 123-45-67"),
    "20": ("10 1234 5678", "16 1234 5678"), "27": ("82 123 4567", "82 123 45678"),
    "30": ("21 0123 4567", "11 0123 4567"), "31": ("6 12345678", "6 92345678"),
    "32": ("470 12 34 56", "430 12 34 56"), "33": ("6 12 34 56 78", "6 12 34 56 7"),
    "34": ("612 345 678", "112 345 678"), "36": ("20 123 4567", "20 123 456"),
    "39": ("06 1234 5678", "6 123 4567"), "40": ("712 345 678", "512 345 678"),
    "41": ("44 668 18 00", "14 668 18 00"), "44": ("20 7946 0018", "40 7946 0018"),
    "45": ("32 12 34 56", "12 12 34 56"), "46": ("8 123 456 78", "8 123 4"),
    "47": ("22 12 34 56", "12 12 34 56"), "48": ("512 345 678", "512 345 67"),
    "49": ("30 123456", "30 1"), "51": ("912 345 678", "212 345 678"),
    "52": ("55 1234 5678", "15 1234 5678"), "53": ("5 1234567", "9 1234567"),
    "54": ("11 1234 5678", "51 1234 5678"), "55": ("11 91234 5678", "11 81234 5678"),
    "56": ("9 1234 5678", "1 1234 5678"), "57": ("301 2345678", "501 2345678"),
    "58": ("412 123 4567", "312 123 4567"), "60": ("12 345 6789", "2 345 6789"),
    "61": ("412 345 678", "612 345 678"), "63": ("917 123 4567", "917 123 456"),
    "64": ("21 123 456", "11 123 456"), "65": ("8123 4567", "7123 4567"),
    "66": ("81 234 5678", "21 234 5678"), "81": ("90 1234 5678", "10 1234 5678"),
    "82": ("10 1234 5678", "90 1234 5678"), "84": ("912 345 678", "612 345 678"),
    "86": ("131 2345 6789", "121 2345 6789"), "90": ("532 123 45 67", "632 123 45 67"),
    "91": ("98765 43210", "08765 4321"), "92": ("301 2345678", "101 2345678"),
    "98": ("912 345 6789", "912 345 678"), "212": ("612 345678", "412 345678"),
    "213": ("551 23 45 67", "851 23 45 67"), "216": ("20 123 456", "10 123 456"),
    "221": ("77 123 45 67", "57 123 45 67"), "225": ("01 23 45 67 89", "41 23 45 67 89"),
    "233": ("24 123 4567", "94 123 4567"), "234": ("802 123 4567", "822 123 4567"),
    "237": ("6 71 23 45 67", "5 71 23 45 67"), "251": ("91 123 4567", "81 123 4567"),
    "254": ("712 345678", "812 345678"), "351": ("912 345 678", "512 345 678"),
    "353": ("85 012 3456", "82 012 3456"), "354": ("611 1234", "111 1234"),
    "370": ("612 34567", "212 34567"), "371": ("21 234 567", "51 234 567"),
    "380": ("50 123 4567", "20 123 4567"), "420": ("601 123 456", "101 123 456"),
    "502": ("5123 4567", "8123 4567"), "503": ("7012 3456", "5012 3456"),
    "504": ("9123 4567", "5123 4567"), "505": ("8123 4567", "6123 4567"),
    "506": ("8312 3456", "1312 3456"), "507": ("6123 4567", "5123 4567"),
    "593": ("99 123 4567", "89 123 4567"), "598": ("94 231 234", "34 231 234"),
    "852": ("5123 4567", "1123 4567"), "971": ("50 123 4567", "53 123 4567"),
    "972": ("50 234 5678", "60 234 5678"), "974": ("3312 3456", "9312 3456"),
}

# Countries with a known number of digits only: valid, not valid. Fixed values.
BY_LENGTH = {"260": ("95 5123456", "95 512345"), "373": ("621 12 345", "621 12 34"), "855": ("91 234 567", "91 234")}

# Calling codes that are not assigned. Fixed values.
UNASSIGNED = ("210 123 4567", "999 123 4567")
