"""X.733 shapes of alarm types, as a dimension to join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

COMMUNICATIONS, SERVICE, EQUIPMENT = "communicationsAlarm", "qualityOfServiceAlarm", "equipmentAlarm"
# Alarm type, event type, probable cause, perceived severity.
SHAPES = [
    ("LOS", COMMUNICATIONS, "lossOfSignal", "critical"),
    ("LOF", COMMUNICATIONS, "lossOfFrame", "critical"),
    ("OpticalPowerLow", COMMUNICATIONS, "lowOpticalPower", "major"),
    ("FiberCut", COMMUNICATIONS, "lossOfSignal", "critical"),
    ("FiberFault", COMMUNICATIONS, "lossOfSignal", "critical"),
    ("PortDown", COMMUNICATIONS, "portDown", "major"),
    ("LineCardFault", EQUIPMENT, "equipmentMalfunction", "critical"),
    ("CRCErrors", COMMUNICATIONS, "thresholdCrossed", "minor"),
    ("PortFlapping", COMMUNICATIONS, "portFlapping", "warning"),
    ("LinkBundleDegraded", SERVICE, "degradedSignal", "major"),
    ("InterfaceDown", COMMUNICATIONS, "interfaceDown", "major"),
    ("InterfaceErrors", COMMUNICATIONS, "thresholdCrossed", "minor"),
    ("IPLinkDown", COMMUNICATIONS, "linkDown", "critical"),
    ("LinkDown", COMMUNICATIONS, "linkDown", "critical"),
    ("ISISAdjacencyDown", COMMUNICATIONS, "adjacencyDown", "major"),
    ("AdjDown", COMMUNICATIONS, "adjacencyDown", "major"),
    ("OSPFAdjacencyDown", COMMUNICATIONS, "adjacencyDown", "major"),
    ("BGPPeerDown", COMMUNICATIONS, "bgpPeerDown", "major"),
    ("RouteFlap", COMMUNICATIONS, "routeFlap", "minor"),
    ("LDPSessionDown", COMMUNICATIONS, "ldpSessionDown", "major"),
    ("LSPDown", COMMUNICATIONS, "lspDown", "major"),
    ("FRRSwitchover", COMMUNICATIONS, "protectionSwitch", "minor"),
    ("TETunnelDown", COMMUNICATIONS, "tunnelDown", "major"),
    ("VPNReachabilityLoss", SERVICE, "reachabilityLoss", "critical"),
    ("ReachabilityLoss", SERVICE, "reachabilityLoss", "critical"),
    ("ServiceDegraded", SERVICE, "serviceDegraded", "major"),
    ("Congestion", SERVICE, "congestion", "minor"),
    ("QueueDrop", SERVICE, "thresholdCrossed", "minor"),
    ("HighLatency", SERVICE, "highLatency", "minor"),
]
COLUMNS = "alarm_type string, event_type string, probable_cause string, perceived_severity string"


def shapes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHAPES, COLUMNS)


def shaped(alarms: DataFrame) -> DataFrame:
    """alarms with event_type, probable_cause and perceived_severity of their type; null for a type without shape."""
    return alarms.join(shapes(alarms.sparkSession), "alarm_type", "left")
