"""keelsieve.functions"""
