"""Pin layouts and sequences on made sheets."""

import pytest
from pyspark.sql import functions as F

from loomline.plans.pin_rules import pinouts

TIMER = ["GND", "TRIG", "OUT", "RESET", "VCC", "DISCH", "THRES", "CONT"]
TIMER_FUNCTIONS = ["Ground", "Trigger input", "Output", "Reset", "VCC", "Discharge", "Threshold input", "Control voltage"]
COUPLER = ["Anode", "Cathode", "No connection", "Emitter", "Collector", "Base"]
GATE = ["1A", "1Y", "2A", "2Y", "3A", "3Y", "GND", "6A", "6Y", "5A", "5Y", "4A", "VCC", "4Y"]
FUNCTIONS_PAGE = "Pin Functions\nPIN\nNAME\nNO.\nI/O\nDESCRIPTION\n"


def numbered(names):
    return list(enumerate(names, 1))


# name: chunks (page, text), expected (pin, function)
CASES = {
    "coupler in one run": ([(2, "An optocoupler\n1 2 3 6 5 4 B C E A C NC")], numbered(COUPLER)),
    "coupler as rows": ([(2, "With base connection\ncapacitance 0.5 pF A 1 6 B\nsix pins\nC 2 5 C\nagencies NC 3 4 E")], numbered(COUPLER)),
    "direct": ([(1, "Pin 1: VCC\nsome words, pin 2 = GND. PIN12–chip select (2)")], [(1, "VCC"), (2, "Ground"), (12, "chip select")]),
    "pipes": ([(3, "Pin | Name | Function\n" + "\n".join(f"{i} | {x} | words" for i, x in numbered(TIMER)))], numbered(TIMER_FUNCTIONS)),
    "pipes, other columns": ([(3, "a | b\n\nDescription | No. | Symbol\n| Supply | 4 | VDD(1)\n Reset | pin 7 | - |\n nothing | 9 | two words\n x | none | OUT")], [(4, "VDD"), (7, "Reset"), (9, "NOTHING")]),
    "cells one a line": ([(4, "PIN DESCRIPTIONS\nDEVICE\nPIN #\nADS1113\nADS1114\nDESCRIPTION\n1\nADDR\nADDR\nDigital Input\nslave address\n2\nNC(1)\nALERT/RDY\nDigital Output\nready\n(3)\nGND\nAnalog\nGround\n8\nVDD\nAnalog\nsupply\n9\nSDA\nDigital I/O\n10\nDEVICE")], [(1, "ADDR"), (2, "ALERT/RDY"), (3, "Ground"), (8, "VDD"), (9, "SDA")]),
    "numbered lines": ([(5, "Terminal Functions\nPin No. Symbol Description\n1 VCC Positive supply\n2  GND reference\nPin 3 SDA data\n4 SCL clock\n5 F single letter")], [(1, "VCC"), (2, "Ground"), (3, "SDA"), (4, "SCL")]),
    "module": ([(2, "PINOUTS\nVCC: 3.3V power\nGND: ground\nSDA: data pin\nSCL: clock\nSHUT: off\nINT: interrupt\nVersion: 3\nEXTRA: no more")], numbered(["VCC", "Ground", "SDA", "SCL", "SHUT", "INT"])),
    "module without colons": ([(2, "Connector\nVDD GND, XSHUT date page VIN")], numbered(["VDD", "Ground", "XSHUT"])),
    "module without supply": ([(2, "Connector\nFOO: a\nBAR: b\nBAZ: c")], []),
    "flat table": ([(10, "Table 2. signal descriptions\nPin number Signal name Signal type\n1 GPIO1 Digital I/O open drain. 2 NC No connect or ground 3 NC No  connect\n4 | GPIO0/CE | Digital I/O | enable. 5 SCL Digital input 8 AVDD_VCSEL Supply 9 AVSSVCSEL Ground ground")], [(1, "GPIO1"), (2, "No connection"), (3, "No connection"), (4, "GPIO0/CE"), (5, "SCL"), (8, "AVDD_VCSEL"), (9, "AVSSVCSEL")]),
    "two sides": ([(3, "14-Pin PDIP Package Top View\n1A 1 14 VCC\n1Y 2 13 6A\n2A 3 12 6Y\n2Y 4 11 5A\n3A 5 10 5Y\n3Y 6 9 4A\nGND 7 8 4Y")], numbered(["1A", "1Y", "2A", "2Y", "3A", "3Y", "Ground", "4Y", "4A", "5Y", "5A", "6Y", "6A", "VCC"])),
    "two sides, too few": ([(3, "SOIC\nOUT 1 2 IN+")], []),
    "sequence": ([(3, "\n".join([*TIMER, "NC", "DISCH", "NC", "THRES", "NC", "NC", "TRIG", "NC - none inside"])), (3, "Pin Functions\nPIN\nD, P\nI/O"), (3, "NAME\nNO.\nwords on VCC\n" + "\n".join(f"{x}\nI\nwords" for x in TIMER))], numbered(TIMER_FUNCTIONS)),
    "sequence without its page": ([(1, "\n".join(TIMER))], []),
    "sequence with another chunk's page": ([(1, "\n".join(TIMER)), (2, FUNCTIONS_PAGE + "\n".join(TIMER))], []),
    "sequence of a gate": ([(3, "\n".join([*GATE, "ph Top View", "2A", "NC", "2Y", "NC", "3A", "20-Pin LCCC", "Top View", "Pin Functions", "PIN", "I/O"])), (3, "NAME\nD, DB\n" + "\n".join(f"{x}\nInput\nChannel" for x in GATE))], numbered([{"GND": "Ground"}.get(x, x) for x in GATE])),
    "sequence by full names": ([(3, "R\nR\nR\nGND\nTRIGGER\nOUTPUT\nRESET\n+VCC\nDISCHARGE\nTHRESHOLD\nCONTROL\nVOLTAGE\nCOMPARATOR\nCOMPARATOR"), (3, "8-Pin PDIP, SOIC\nTop View\n" + FUNCTIONS_PAGE), (3, "Control\nVoltage\nI\nDischarge\nGND\nOutput\nReset\nThreshold\nTrigger\nV+\nwords")], numbered(TIMER_FUNCTIONS)),
    "labels without support go": ([(3, "\n".join([*TIMER, "WAKE"]) + "\n" + FUNCTIONS_PAGE + "\n".join(TIMER))], numbered(TIMER_FUNCTIONS)),
    "longer sequence replaces": ([(1, "Pin 1: OTHER\nPin 40: FAR"), (3, "\n".join(TIMER) + "\n" + FUNCTIONS_PAGE + "\n".join(TIMER))], [*numbered(TIMER_FUNCTIONS), (40, "FAR")]),
    "weaker sequence fills gaps": ([(1, "\n".join(f"Pin {i}: VDD" for i in range(2, 12))), (3, "GND\nFOO1\nBAR1\nBAZ1\n" + FUNCTIONS_PAGE + "GND\nFOO1\nBAR1\nBAZ1")], [(1, "Ground"), *((i, "VDD") for i in range(2, 12))]),
    "first chunk and layout win": ([(1, "Pin 1: OUT"), (1, "Pin 1: GND\nPin | Name\n2 | VCC\nPin 2: GND")], [(1, "Output"), (2, "VCC")]),
    "nothing": ([(1, None), (None, ""), (None, "words " * 20000)], []),
}


@pytest.fixture(scope="module")
def found(spark):
    rows = [(name, page, i, text) for name, (chunks, _) in CASES.items() for i, (page, text) in enumerate(chunks)]
    frame = spark.createDataFrame(rows, "doc string, page int, chunk_index int, text string").withColumns({"label": F.lit("x"), "lines": F.lit(1), "upper": F.lit(2)})
    out = {name: [] for name in CASES}
    for r in pinouts(frame).collect():
        out[r.doc].append((r.pin, r.function))
    return out


@pytest.mark.parametrize("name", CASES)
def test_case(found, name):
    assert sorted(found[name]) == CASES[name][1]


def test_no_rows(spark):
    assert pinouts(spark.createDataFrame([], "doc string, page int, chunk_index int, text string")).count() == 0
