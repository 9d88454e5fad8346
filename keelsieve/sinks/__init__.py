"""keelsieve.sinks"""
