"""Protocol and service names.  Applied after aggregation, as a constant map lookup."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# IP protocol number -> short name.
PROTOCOLS = {
    0: "HOPOPT", 1: "ICMP", 2: "IGMP", 4: "IPv4", 6: "TCP", 17: "UDP", 27: "RDP", 33: "DCCP", 41: "IPv6",
    46: "RSVP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPv6", 88: "EIGRP", 89: "OSPF", 103: "PIM",
    112: "VRRP", 132: "SCTP", 136: "UDP-Lite",
}

# TCP port -> service name.
TCP_SERVICES = {
    20: "FTP-DATA", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 43: "WHOIS", 53: "DNS", 80: "HTTP",
    110: "POP3", 111: "RPC", 113: "IDENT", 119: "NNTP", 135: "MSRPC", 139: "NetBIOS", 143: "IMAP",
    179: "BGP", 389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 514: "Syslog", 587: "SMTP-Submit",
    636: "LDAPS", 853: "DNS-over-TLS", 873: "rsync", 989: "FTPS-Data", 990: "FTPS", 993: "IMAPS",
    995: "POP3S", 1080: "SOCKS", 1194: "OpenVPN", 1433: "MSSQL", 1521: "Oracle", 1723: "PPTP",
    2049: "NFS", 2082: "cPanel", 2083: "cPanel-SSL", 2181: "ZooKeeper", 2375: "Docker",
    2376: "Docker-TLS", 3128: "Squid-Proxy", 3306: "MySQL", 3389: "RDP", 4444: "Metasploit",
    5000: "UPnP", 5060: "SIP", 5222: "XMPP", 5269: "XMPP-Server", 5432: "PostgreSQL", 5601: "Kibana",
    5672: "AMQP", 5900: "VNC", 5984: "CouchDB", 6379: "Redis", 6443: "Kubernetes-API",
    6660: "IRC", 6661: "IRC", 6662: "IRC", 6663: "IRC", 6664: "IRC", 6665: "IRC", 6666: "IRC", 6667: "IRC", 6668: "IRC", 6669: "IRC",
    7001: "Cassandra", 7077: "Spark", 8000: "HTTP-Alt", 8008: "HTTP-Alt", 8080: "HTTP-Proxy",
    8081: "HTTP-Alt", 8088: "HTTP-Alt", 8443: "HTTPS-Alt", 8883: "MQTT-TLS", 9000: "HTTP-Alt",
    9090: "Prometheus", 9092: "Kafka", 9200: "Elasticsearch", 9300: "Elasticsearch", 9418: "Git",
    10050: "Zabbix", 10051: "Zabbix-Trap", 11211: "Memcached", 15672: "RabbitMQ", 25565: "Minecraft",
    27017: "MongoDB", 27018: "MongoDB", 50070: "Hadoop",
}

# UDP port -> service name.
UDP_SERVICES = {
    53: "DNS", 67: "DHCP-Server", 68: "DHCP-Client", 69: "TFTP", 123: "NTP", 137: "NetBIOS-NS",
    138: "NetBIOS-DGM", 161: "SNMP", 162: "SNMP-Trap", 389: "LDAP", 443: "HTTP/3", 500: "IKE",
    514: "Syslog", 520: "RIP", 1194: "OpenVPN", 1812: "RADIUS-Auth", 1813: "RADIUS-Acct", 1900: "SSDP",
    2055: "NetFlow", 4500: "IPsec-NAT-T", 5060: "SIP", 5353: "mDNS", 6343: "sFlow", 11211: "Memcached",
    27015: "Source-Game", 51820: "WireGuard",
}


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _constant_map(entries: dict[int, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def protocol_name(protocol) -> Column:
    n = _c(protocol).cast("int")
    return F.coalesce(_constant_map(PROTOCOLS)[n], F.concat(F.lit("proto:"), n.cast("string")))


def service_name(protocol, port) -> Column:
    proto, p = _c(protocol).cast("int"), _c(port).cast("int")
    return F.coalesce(
        F.when(proto == 6, _constant_map(TCP_SERVICES)[p]).when(proto == 17, _constant_map(UDP_SERVICES)[p]),
        F.lit(""),
    )


def services_table(spark: SparkSession) -> DataFrame:
    """The same names as a (protocol, port, service) dimension for row-level joins."""
    rows = [(6, p, s) for p, s in TCP_SERVICES.items()] + [(17, p, s) for p, s in UDP_SERVICES.items()]
    return spark.createDataFrame(rows, "protocol int, port int, service string")
