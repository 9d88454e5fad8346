"""keelsieve.streaming"""
